import hashlib
import json
import math

import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import traceline.operators.embed as embedding
from traceline.operators.embed import HashModel, LoadedModel, embed, embed_two_models, embedded_ok, failed_files, run_counts
from traceline.operators.index import build_index
from traceline.operators.nest import byte_blocks, tree_documents
from traceline.operators.requirements import clean_requirements, dropped_requirements, section_queries, section_vectors

MODEL = HashModel("m", 16)


def by_hand(text, dim=16, first=0):
    counts = [0] * dim
    word = ""
    for c in text + " ":
        if c.isascii() and c.isalnum():
            word += c.lower()
        elif word:
            counts[int(hashlib.md5(word.encode()).hexdigest()[first : first + 8], 16) % dim] += 1
            word = ""
    length = math.sqrt(sum(c * c for c in counts))
    return [c / length for c in counts] if length else None


def files(spark, texts):
    return spark.createDataFrame([("r", i, f"f{i}", t) for i, t in enumerate(texts)], "repo_id string, pos long, path string, content string")


def test_hash_model(spark):
    texts = ["Foo bar foo", "été-B2b x", "   ", "", None, "x" * 5000 + " y", "long " * 300]
    found = {r.path: r for r in embed(files(spark, texts), "content", MODEL).collect()}
    for i, text in enumerate(texts):
        expected = by_hand(text or "")
        assert found[f"f{i}"].embedding == (expected and pytest.approx(expected, abs=1e-6))
        assert found[f"f{i}"].error == (None if expected else "no words")


def test_refused_texts_fail_and_are_counted(spark, rows):
    picky = HashModel("s", 16, refuse="c")
    embedded = embed(files(spark, ["a b", "a b c", "."]), "content", picky)
    assert rows(failed_files(embedded)) == [("r", "s", "f1", "refused text"), ("r", "s", "f2", "no words")]
    assert rows(run_counts(embedded)) == [("r", "s", 3, 1, 2)]
    assert rows(embedded_ok(embedded), "path") == [("f0",)]


def test_two_models_keep_files_both_embed(spark, rows):
    both = embed_two_models(files(spark, ["a b", "a b c"]), "content", HashModel("s", 16, refuse="c"), HashModel("t", 8, 8))
    assert rows(both, "path", F.size("embedding_1"), F.size("embedding_2")) == [("f0", 16, 8)]


def test_loaded_model_isolates_errors(spark):
    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("cannot embed")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    found = embed(files(spark, ["a", "bad", "abc"]), "content", LoadedModel("l", 2, load)).orderBy("pos").collect()
    assert [r.embedding for r in found] == [[1.0, 1.0], None, [3.0, 1.0]]
    assert [r.error for r in found] == [None, "cannot embed", None]


def test_loaded_model_of_wrong_dimension_raises(spark):
    with pytest.raises(Exception, match="dimension mismatch"):
        embed(files(spark, ["a"]), "content", LoadedModel("l", 3, lambda: lambda texts: [[1.0]] * len(texts))).collect()


REQUIREMENTS = [
    (5, "B", "second (x)"),
    (1, "A", "one"),
    (2, "B", "first"),
    (3, "A", "[DELETED, gone]"),
    (9000, "A", "two"),
    (6, None, "no section"),
    (7, "B", None),
]


def test_section_texts_follow_row_order(spark, rows):
    table = spark.createDataFrame(REQUIREMENTS, "row_idx long, section_name string, req_description string")
    cleaned = clean_requirements(table)
    assert rows(section_queries(cleaned)) == [("A", 1, "one two"), ("B", 2, "first second")]
    assert tuple(dropped_requirements(table).first()) == (1, 1, 1)


def test_section_vectors_equal_those_of_the_joined_text(spark):
    table = spark.createDataFrame(REQUIREMENTS, "row_idx long, section_name string, req_description string")
    cleaned = clean_requirements(table)
    summed = {r.section_name: r.embedding for r in section_vectors(cleaned, MODEL).collect()}
    joined = {r.section_name: r.embedding for r in embed(section_queries(cleaned), "query_text", MODEL).collect()}
    assert summed == joined


def test_long_vectors_are_made_in_slices(spark, monkeypatch):
    """Slices give what whole batches give, and a model never gets more texts than it asked for."""
    texts = [f"word{i} other{i % 7}" if i % 5 else "..." for i in range(40)] + [None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string").coalesce(1)
    whole = embed(table, "content", MODEL).orderBy("i").collect()
    monkeypatch.setattr("traceline.operators.embed.CELLS", 3 * MODEL.dim)
    assert embed(table, "content", MODEL).orderBy("i").collect() == whole

    def load():
        def vectors(given):
            assert len(given) <= 4
            return [[float(len(given)), float(len(t))] for t in given]

        return vectors

    found = embed(table.where("content is not null"), "content", LoadedModel("own", 2, load, batch=4)).orderBy("i").collect()
    assert [r.embedding[1] for r in found] == [len(t) for t in texts[:-1]] and all(r.error is None for r in found)


def test_parts_of_a_payload_are_bounded_by_bytes(spark):
    sizes = [10, 400, 30, 2000, 5, 5, 900, 100, 100, 100] * 130
    rows = [("r", i, f"f{i}", "x" * n) for i, n in enumerate(sizes)] + [("s", 0, "only", "y")]
    tree = spark.createDataFrame(rows, "repo_id string, pos long, path string, content string").repartition(5)
    found = byte_blocks(tree, 2000).orderBy("repo_id", "pos").collect()
    assert [(r.repo_id, r.pos) for r in found] == [(r[0], r[1]) for r in rows]
    total, count = {}, {}
    for r in found:
        at = r.repo_id, r.block
        total[at] = total.get(at, 0) + len(r.content) + len(r.path) + 64
        count[at] = count.get(at, 0) + 1
    assert all(n <= 2000 or count[at] == 1 for at, n in total.items())
    assert len(total) < 0.5 * len(rows)
    documents = tree_documents(tree, max_bytes=2000).collect()
    assert sorted(k for d in documents for k in json.loads(d.tree)) == sorted(r[2] for r in rows)
    assert all(len(d.tree) <= 2000 or len(json.loads(d.tree)) == 1 for d in documents)


def test_counts_come_with_the_pass_that_embeds(spark):
    """One scan: the observed numbers are there once the vectors are written."""
    files = spark.createDataFrame([("r", i, f"f{i}", "word" if i % 4 else "...") for i in range(20)], "repo_id string, pos long, path string, content string")
    counts = Observation("run")
    index = build_index(files, MODEL, counts)
    assert counts.get == {"files_found": 20, "files_indexed": 15, "files_failed": 5} and index.count() == 15
    plan = embed(files, "content", MODEL).observe(Observation("again"), F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CollectMetrics" in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_words_of_long_texts_are_held_a_run_at_a_time(spark, monkeypatch):
    """Runs of few bytes give what whole batches give; a text longer than a run stays whole."""
    texts = ["one two " * n for n in (1, 50, 0, 3, 400, 2, 2)] + [None]
    column, seen = pa.array(texts), {}
    monkeypatch.setattr("traceline.operators.embed.SLICE_BYTES", 420)
    runs = [column[part].to_pylist() for part in embedding._slices(column, 100)]
    assert [t for run in runs for t in run] == texts
    assert all(len(run) == 1 or sum(len(t or "") for t in run) <= 420 for run in runs) and len(runs) == 4
    monkeypatch.setattr("traceline.operators.embed.SEEN_WORDS", 2)
    for words in ("a b c", "d e f", "g"):
        embedding._words(pa.array([words]), 8, 0, seen)
        assert len(seen) <= 5
    assert embedding._words(pa.array(["a b a"]), 8, 0, seen)[1].tolist() == embedding._words(pa.array(["a b a"]), 8, 0, {})[1].tolist()


def test_remembered_words_stay_few_in_one_long_run(monkeypatch):
    monkeypatch.setattr("traceline.operators.embed.SEEN_WORDS", 50)
    seen = {}
    text = pa.array([" ".join(f"w{i}" for i in range(1000))])
    found = embedding._words(text, 64, 0, seen)
    assert len(seen) <= 50
    again = embedding._words(text, 64, 0, {})
    assert all((a == b).all() for a, b in zip(found, again)) and len(found[1]) == 1000


def test_short_words_are_hashed_many_at_once(monkeypatch):
    """As hashlib hashes them, whatever their lengths and the digits used, without a call of it a word."""
    words = ["x" * n for n in (*range(1, 60), 64, 119, 120)] + [f"w{i}z" for i in range(300)]
    monkeypatch.setattr("traceline.operators.embed.HASHED", 100)
    called, md5 = [], hashlib.md5
    monkeypatch.setattr(embedding.hashlib, "md5", lambda data: called.append(data) or md5(data))
    for first in (0, 3, 8, 24, 27):
        row, bucket = embedding._words(pa.array([" ".join(words)]), 61, first, {})
        assert bucket.tolist() == [int(md5(w.encode()).hexdigest()[first : first + 8], 16) % 61 for w in words]
        assert len(row) == len(words) and max(row) == 0
    assert called and all(len(word) > 55 for word in called)


def test_words_end_with_their_text():
    texts = pa.array(["no", "ab", "ab cd", None, "", "é", "cdé", "ab\n", ".", "x" * 70, "AB"])
    for column in (texts, texts.cast(pa.large_string()), pa.concat_arrays([texts, texts]).slice(11)):
        row, words = embedding._split(column.slice(1))
        assert list(zip(row.tolist(), words.to_pylist())) == [(0, "ab"), (1, "ab"), (1, "cd"), (5, "cd"), (6, "ab"), (8, "x" * 70), (9, "ab")]
    for empty in (texts.slice(0, 0), pa.array([None, ""], pa.string()), pa.array(["x" * 60])):
        row, bucket = embedding._words(empty, 8, 0, {})
        assert len(row) == len(bucket) == (empty.to_pylist() == ["x" * 60])
