import pytest

from traceline.operators.evaluate import confusion_counts, eval_input, eval_retrieved, metrics_summary, model_wins, retrieve_accuracy, with_metrics

RESULT = "model string, section_name string, kind string, pos int, file_name string, score double"

# Counts and the metrics expected for them.
GOLDEN = [
    ((1, 1, 67, 0), (0.5, 1.0, 0.6666666666666666, 0.9852941176470589, 0.9926470588235294)),
    ((0, 28, 40, 1), (0.0, 0.0, None, 0.5882352941176471, 0.29411764705882354)),
    ((1, 0, 68, 0), (1.0, 1.0, 1.0, 1.0, 1.0)),
    ((0, 69, 0, 0), (0.0, None, None, 0.0, None)),
]


def counts(spark):
    return spark.createDataFrame([(f"s{i}", *c) for i, (c, _) in enumerate(GOLDEN)], "section_name string, TP int, FP int, TN int, FN int")


def test_metrics(spark):
    found = with_metrics(counts(spark)).orderBy("section_name").collect()
    for row, (_, expected) in zip(found, GOLDEN):
        assert tuple(row)[5:] == tuple(e if e is None else pytest.approx(e, abs=1e-12) for e in expected)


def test_summary_skips_undefined_values(spark):
    row = metrics_summary(with_metrics(counts(spark))).first()
    assert (row.sections, row.TP, row.FP, row.TN, row.FN, row.perfect_sections) == (4, 2, 98, 175, 1, 1)
    assert row.macro_recall == pytest.approx(2 / 3)
    assert row.macro_f1_score == pytest.approx((2 / 3 + 1) / 2)
    assert row.micro_precision == pytest.approx(0.02)


def test_confusion_counts_cover_the_universe(spark, rows):
    pairs = lambda *p: spark.createDataFrame(list(p), "section_name string, file_name string")
    universe = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "file_name string")
    found = confusion_counts(pairs(("S", "a"), ("S", "b"), ("T", "zz")), pairs(("S", "a"), ("S", "c"), ("U", "d")), universe)
    assert rows(found) == [("S", 1, 1, 1, 1), ("T", 0, 0, 4, 0), ("U", 0, 0, 3, 1)]


def results(spark):
    table = [
        ("m", "S", "common_files", 1, "x.php", 0.9),
        ("m", "S", "common_files", 2, "S.php", 0.7),
        ("m", "S", "common_files", 3, "S.php", 0.6),
        ("m", "T", "only_one_model", 1, "T.php", 0.5),
        ("m", "E", None, None, None, None),
        ("n", "S", "common_files", 1, "S.php", 0.6),
        ("n", "T", "common_files", 1, "T.php", 0.2),
    ]
    return spark.createDataFrame(table, RESULT)


def test_expected_files(spark, rows):
    assert rows(eval_retrieved(results(spark))) == [("m", "E", 0, 0.0), ("m", "S", 1, 0.6), ("m", "T", 0, 0.0), ("n", "S", 1, 0.6), ("n", "T", 1, 0.2)]


def test_accuracy(spark, rows):
    evaluated = eval_retrieved(results(spark))
    assert rows(retrieve_accuracy(evaluated, ["model"])) == [("m", 1, 3, pytest.approx(100 / 3)), ("n", 2, 2, 100.0)]
    none = retrieve_accuracy(eval_retrieved(results(spark).where("section_name = 'E'"))).first()
    assert tuple(none) == (0, 1, 0.0)
    assert retrieve_accuracy(eval_retrieved(results(spark).limit(0))).first().accuracy is None


def test_ties_win_for_both(spark, rows):
    assert rows(model_wins(eval_retrieved(results(spark)))) == [("m", 1), ("n", 2)]


def test_sections_without_common_files_stay(spark, rows):
    table = [
        ("m", "only", "only_one_model", 1, "a.php", 0.5),
        ("m", "none", None, None, None, None),
        ("m", "both", "common_files", 1, "b.php", 0.25),
        ("m", "both", "only_one_model", 1, "c.php", 0.75),
    ]
    found = eval_input(spark.createDataFrame(table, RESULT))
    assert rows(found, "section_name", "file_name", "score") == [("both", "b.php", 0.25), ("none", None, None), ("only", None, None)]


def test_named_sections_are_counted_without_finds(spark, rows):
    pair = "section_name string, file_name string"
    got, due = spark.createDataFrame([("s", "a")], pair), spark.createDataFrame([("s", "b")], pair)
    universe = spark.createDataFrame([(x,) for x in "abcd"], "file_name string")
    sections = spark.createDataFrame([("s",), ("t",)], "section_name string")
    found = confusion_counts(got, due, universe, sections=sections)
    assert rows(found, "section_name", "TP", "FP", "TN", "FN") == [("s", 0, 1, 2, 1), ("t", 0, 0, 4, 0)]
