"""How well results match what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a section is answered by the file of its name with this suffix.
EXPECTED_SUFFIX = ".php"


def eval_input(results: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Common files of every section, last score per name; other lists go unread.

    A section without common files keeps one row whose file is NULL.
    """
    key = key or ["model", "section_name"]
    common = F.coalesce(F.col("kind") == "common_files", F.lit(False))
    found = results.where(common & F.col("file_name").isNotNull()).groupBy(*key, "file_name").agg(F.max_by("score", "pos").alias("score"))
    bare = results.groupBy(*key).agg(F.max(common & F.col("file_name").isNotNull()).alias("_any")).where(~F.col("_any"))
    none = [F.lit(None).cast(results.schema[c].dataType).alias(c) for c in ("file_name", "score")]
    return found.unionByName(bare.select(*key, *none))


def eval_retrieved(results: DataFrame, suffix: str = EXPECTED_SUFFIX, key: list[str] | None = None) -> DataFrame:
    """Per section whether its expected file was found, and its score.

    The expected name follows from the section, so the left join to it is a
    conditional aggregate: no shuffle beyond the one by section, and a section
    with any number of files is reduced before it.
    """
    key = key or ["model", "section_name"]
    hit = (F.col("kind") == "common_files") & (F.col("file_name") == F.concat(F.col("section_name"), F.lit(suffix)))
    found = F.max_by(F.when(hit, F.col("score")), F.when(hit, F.col("pos")))
    return results.groupBy(*key).agg(
        F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("retrieved"), F.coalesce(found, F.lit(0.0)).alias("score")
    )


def retrieve_accuracy(evaluated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Found sections, all sections and their ratio in percent."""
    return evaluated.groupBy(*(by or [])).agg(
        F.sum("retrieved").alias("ones_count"),
        F.count("*").alias("row_count"),
        (100 * F.avg("retrieved")).alias("accuracy"),
    )


def model_wins(evaluated: DataFrame) -> DataFrame:
    """Sections won by each model: found with the highest score, ties count for all.

    A section has one row per model, which bounds the window.
    """
    best = Window.partitionBy("section_name").orderBy(F.col("score").desc())
    return (
        evaluated.where(F.col("retrieved") == 1)
        .withColumn("_place", F.rank().over(best))
        .where(F.col("_place") == 1)
        .groupBy("model")
        .agg(F.count("*").alias("wins"))
    )


def confusion_counts(
    retrieved: DataFrame,
    relevant: DataFrame,
    universe: DataFrame,
    section: str = "section_name",
    file: str = "file_name",
    sections: DataFrame | None = None,
) -> DataFrame:
    """TP, FP, TN, FN (long) per section over a universe of files.

    Only retrieved and relevant pairs are looked at; the true negatives are the
    rest of the universe, so sections and files are never crossed. ``sections``
    names sections that get a row even when nothing was found or due.
    """
    files = universe.select(file).distinct()
    size = files.agg(F.count("*")).scalar()
    marks = (
        retrieved.select(section, file, F.lit(1).alias("_got"), F.lit(0).alias("_due"))
        .unionByName(relevant.select(section, file, F.lit(0).alias("_got"), F.lit(1).alias("_due")))
        .groupBy(section, file)
        .agg(F.max("_got").alias("_got"), F.max("_due").alias("_due"))
    )
    # A name outside the universe keeps its section but counts nowhere.
    inside = marks.join(files.withColumn("_in", F.lit(True)), file, "left")

    def count(got: int, due: int) -> Column:
        return F.count_if(F.col("_in") & (F.col("_got") == got) & (F.col("_due") == due))

    counted = inside.groupBy(section).agg(count(1, 1).alias("TP"), count(1, 0).alias("FP"), count(0, 1).alias("FN"))
    if sections is not None:
        counted = sections.select(section).distinct().join(counted, section, "left").na.fill(0, ["TP", "FP", "FN"])
    rest = size - F.col("TP") - F.col("FP") - F.col("FN")
    return counted.select(section, "TP", "FP", rest.alias("TN"), "FN")


def with_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, specificity, balanced accuracy; NULL if undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    ratios = counts.withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return (
        ratios.withColumn("f1_score", F.try_divide(2 * p * r, p + r))
        .withColumn("specificity", F.try_divide(tn, tn + fp))
        .withColumn("balanced_accuracy", (r + F.col("specificity")) / 2)
    )


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """Totals, macro means over the defined values, and micro values."""
    names = ["precision", "recall", "f1_score", "specificity", "balanced_accuracy"]
    totals = metrics.agg(
        F.count("*").alias("sections"),
        *[F.sum(c).alias(c) for c in ("TP", "FP", "TN", "FN")],
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        F.count_if((F.col("precision") == 1) & (F.col("recall") == 1)).alias("perfect_sections"),
    )
    micro = with_metrics(totals)
    return micro.select(*totals.columns, *[F.col(c).alias(f"micro_{c}") for c in names])
