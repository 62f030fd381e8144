import math

import pytest
from pyspark.sql import functions as F

from traceline.operators import hits as h
from traceline.plans.match import dual_results, single_results

KEY = ["repo_id", "section_name"]
SCHEMA = "repo_id string, section_name string, first_row long, rk int, idx long, path string, distance double"


def ranking(spark, *lists):
    """One ranking per (section, [(path, distance), ...])."""
    out = []
    for first_row, (section, files) in enumerate(lists):
        out += [("r", section, first_row, rk, rk, path, float(d)) for rk, (path, d) in enumerate(files, 1)]
    return spark.createDataFrame(out, SCHEMA)


FILES = [("x/a.php", 0.1), ("y/b.php", 0.4), ("x/c.php", 0.6), ("z/a.php", 0.9), ("q/d.php", 1.2), ("w/c.php", 1.3)]


# Worked out by hand. Four hits are farther than 0.5; their scores are 0.825 0.622 0.362 0.267.
EXPECTED = {
    # Each kept hit has its own score: c 0.825, a 0.622, d 0.362, c 0.267; the second c replaces the first one's score.
    "aligned": [("c.php", 0.26749883), ("a.php", 0.62160997), ("d.php", 0.36235775)],
    # The scores go to the first four files: a, b, c and again a.
    "positional": [("a.php", 0.26749883), ("b.php", 0.62160997), ("c.php", 0.36235775)],
}


@pytest.mark.parametrize("pairing", ["aligned", "positional"])
def test_single_model_lists(spark, pairing):
    found = single_results(ranking(spark, ("S", FILES), ("T", [("a.php", 0.2)])), pairing=pairing).collect()
    section = sorted((r.pos, r.file_name, r.score) for r in found if r.section_name == "S")
    assert [(pos, name) for pos, name, _ in section] == [(i, name) for i, (name, _) in enumerate(EXPECTED[pairing], 1)]
    assert [s for _, _, s in section] == pytest.approx([s for _, s in EXPECTED[pairing]], abs=1e-7)
    # A section without results is kept as one row without a file.
    assert [tuple(r)[3:] for r in found if r.section_name == "T"] == [(None, None, None, None)]


def test_pairings_agree_when_nothing_is_dropped(spark, rows):
    far = ranking(spark, ("S", [(p, d + 1) for p, d in FILES]))
    assert rows(single_results(far), "pos", "file_name", "score") == rows(
        single_results(far, pairing="positional"), "pos", "file_name", "score"
    )


def test_no_threshold_and_score_threshold(spark, rows):
    table = ranking(spark, ("S", FILES))
    assert h.threshold_aligned(table, None).count() == 6
    assert rows(h.threshold_aligned(table, None, min_score=0.8), "path") == [("x/a.php",), ("x/c.php",), ("y/b.php",)]


def lists(spark):
    first = ranking(spark, ("S", FILES), ("T", [("k.php", 0.1)]))
    second = ranking(spark, ("S", [("x/b.php", 0.7), ("x/c.php", 0.8), ("v/e.php", 1.1), ("v/a.php", 1.15)]), ("T", [("k.php", 0.3)]))
    return first, second


def test_two_models(spark, rows):
    first, second = lists(spark)
    a, b = (h.model_file_scores(h.threshold_aligned(t)) for t in (first, second))
    common = {n: s for n, s in rows(h.common_files(a, b), "file_name", "score")}
    unique = rows(h.unique_files(a, b), "src", "file_name")
    assert common == {"c.php": pytest.approx((math.cos(1.3) + math.cos(0.8)) / 2), "a.php": pytest.approx((math.cos(0.9) + math.cos(1.15)) / 2)}
    assert unique == [(1, "d.php"), (2, "b.php"), (2, "e.php")]
    names = {n for t in (a, b) for (n,) in rows(t, "file_name")}
    assert names == set(common) | {n for _, n in unique}


@pytest.mark.parametrize("depth", [None, 6])
def test_merged_lists_equal_the_separate_operators(spark, rows, depth):
    first, second = lists(spark)
    found = dual_results(first, second, depth=depth)
    a, b = (h.model_file_scores(h.threshold_aligned(t)) for t in (first, second))
    in_order = [tuple(r) for r in found.where("pos is not null").orderBy("kind", "pos").select("kind", "pos", "file_name").collect()]
    assert in_order == [
        ("common_files", 1, "c.php"),
        ("common_files", 2, "a.php"),
        ("only_one_model", 1, "d.php"),
        ("only_one_model", 2, "b.php"),
        ("only_one_model", 3, "e.php"),
    ]
    separate = h.common_files(a, b).select("file_name", F.round("score", 12)).union(h.unique_files(a, b).select("file_name", F.round("score", 12)))
    assert rows(found.where("pos is not null"), "file_name", F.round("score", 12)) == rows(separate)
    assert rows(found.where("pos is null"), "section_name", "kind", "file_name") == [("T", None, None)]
