import base64

import pytest
from pyspark.sql import functions as F

from traceline.functions.codec import encode_blob
from traceline.functions.prompts import EMPTY_FILE_MESSAGE, summary_prompt, task_prompt
from traceline.functions.text import base_name, fill, is_active, is_blank, is_source_file, without_parentheses
from traceline.sources.readers import decode_files


def column(spark, values, make):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(make(F.col("x"))).collect()]


def test_suffix_is_case_sensitive_and_at_the_very_end(spark):
    names = ["a.py", "b/c.vue", "x.htm", "A.PHP", "a.php\n", ".env.example", "php"]
    assert column(spark, names, is_source_file) == [True, True, True, False, False, False, False]


def test_base_name(spark):
    assert column(spark, ["a/b/c.php", "c.php", "a/"], base_name) == ["c.php", "c.php", ""]


def test_requirement_cleaning(spark):
    texts = ["ok (a) end", "ok ([a](b))", "two (a) (b)", "none", "open ( end"]
    assert column(spark, texts, without_parentheses) == ["ok end", "ok)", "two", "none", "open ( end"]
    assert column(spark, ["[DELETED, x]", "kept [x]"], is_active) == [False, True]


def test_blank(spark):
    assert column(spark, ["", " \n\t", " \x1f", " a "], is_blank) == [True, True, True, False]


def test_fill_keeps_braces_of_values(spark):
    made = column(spark, ["{b}"], lambda x: fill("<{a}|{b}|{a}>", a=x, b=F.lit("2")))
    assert made == ["<{b}|2|{b}>"]


def test_prompts(spark):
    q, p = F.lit("why"), F.lit("a.php")
    assert column(spark, ["\n\t"], lambda x: task_prompt(q, p, x)) == [EMPTY_FILE_MESSAGE]
    text = column(spark, ["code"], lambda x: task_prompt(q, p, x))[0]
    assert "User's Question: why \n    Top Matching File: a.php \n    Contents of the File: code \n" in text
    assert 'task of " why" in 2 lines' in column(spark, ["\n"], lambda x: summary_prompt(q, p, x))[0]


def tree(spark, blobs):
    return spark.createDataFrame(
        [("r", i, f"f{i}.php", b) for i, b in enumerate(blobs)], "repo_id string, pos long, path string, content string"
    )


def test_decoding_is_lenient_on_strays_and_strict_on_the_rest(spark, rows):
    good = base64.b64encode("päth".encode()).decode()
    blobs = [good, good[:2] + "\n" + good[2:], "QU*JD", "QUI=trailing", "QUI", "A", "/0E=", None, ""]
    found = dict(rows(decode_files(tree(spark, blobs), on_error="null"), "pos", F.struct("content", "error")))
    assert {k: tuple(v) for k, v in found.items()} == {
        0: ("päth", None),
        1: ("päth", None),
        2: ("ABC", None),
        3: ("AB", None),
        4: (None, "incorrect base64 padding"),
        5: (None, "incorrect base64 padding"),
        6: (None, "invalid utf-8"),
        7: (None, "no content"),
        8: ("", None),
    }


def test_bad_file_ends_the_job_by_default(spark):
    with pytest.raises(Exception, match="cannot decode f0.php: incorrect base64 padding"):
        decode_files(tree(spark, ["A"])).collect()


def test_encoding_round_trip(spark, rows):
    text = "ünï\n" * 200
    encoded = tree(spark, [text]).withColumn("content", encode_blob(F.col("content")))
    assert rows(encoded, "content") == [(base64.b64encode(text.encode()).decode(),)]
    assert rows(decode_files(encoded), "content") == [(text,)]
