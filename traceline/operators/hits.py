"""From distances to results: thresholds, base names, two-model algebra.

Results are keyed by ``(repo_id, section_name)``. Hits carry ``rk``, ``path``
and ``distance``; a file list carries ``file_name``, ``score`` and ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.functions.scoring import score
from traceline.functions.text import base_name

KEY = ["repo_id", "section_name"]

# Fixed value: hits must be farther than this. It drops the closest files, not
# the farthest; ``min_score`` is for those who want the latter.
MIN_DISTANCE = 0.5


def with_score(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", score(F.col("distance")))


def passes(min_distance: float | None, min_score: float | None = None) -> Column:
    kept = F.lit(True)
    if min_distance is not None:
        kept &= F.col("distance") > min_distance
    if min_score is not None:
        kept &= score(F.col("distance")) > min_score
    return kept


def threshold_aligned(
    hits: DataFrame, min_distance: float | None = MIN_DISTANCE, min_score: float | None = None
) -> DataFrame:
    """Drop hits, each file keeping its own score."""
    return with_score(hits.where(passes(min_distance, min_score)))


def threshold_positional(
    hits: DataFrame, min_distance: float = MIN_DISTANCE, key: list[str] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Drop scores, then pair what is left with the files from the front.

    With ``m`` dropped scores the file at rank r gets the score of rank r+m and
    the last m files vanish. Each hit is sent to its own rank as a file and to
    rank-m as a score, and the two halves meet in one aggregation whose keys
    are unique ranks, so a long ranking spreads over many tasks.
    """
    key = key or KEY
    keep = keep or ["idx", "path"]
    near = hits.where(F.col("distance") <= min_distance).groupBy(*key).agg(F.count("*").alias("_m"))
    marked = hits.join(near, key, "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    kept = F.struct(*keep)
    halves = marked.select(
        *key,
        F.explode(
            F.array(
                F.struct(F.col("rk").alias("rk"), kept.alias("file"), F.lit(None).cast("double").alias("score")),
                F.struct(
                    (F.col("rk") - F.col("_m")).cast("int").alias("rk"),
                    F.lit(None).cast(hits.select(kept).schema[0].dataType).alias("file"),
                    score(F.col("distance")).alias("score"),
                ),
            )
        ).alias("h"),
    ).select(*key, "h.*")
    met = halves.groupBy(*key, "rk").agg(F.max("file").alias("file"), F.max("score").alias("score"))
    return met.where(F.col("file").isNotNull() & F.col("score").isNotNull()).select(*key, "rk", "file.*", "score")


def dedupe_basename(scored: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per base name: score of its last hit, position of its first."""
    key = key or KEY
    return scored.groupBy(*key, base_name(F.col("path")).alias("file_name")).agg(
        F.max_by("score", "rk").alias("score"), F.min("rk").alias("pos")
    )


def model_file_scores(scored: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The file list of one model."""
    return dedupe_basename(scored, key).select(*(key or KEY), "pos", "file_name", "score")


def common_files(first: DataFrame, second: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Files in both lists with the mean score, in the order of the first."""
    key = key or KEY
    other = second.select(*key, "file_name", F.col("score").alias("_s"))
    return first.join(other, [*key, "file_name"]).select(
        *key, "pos", "file_name", ((F.col("score") + F.col("_s")) / 2).alias("score")
    )


def unique_files(first: DataFrame, second: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Files in one list only; ``src`` 1 comes before ``src`` 2."""
    on = [*(key or KEY), "file_name"]
    only_first = first.join(second, on, "left_anti").withColumn("src", F.lit(1))
    only_second = second.join(first, on, "left_anti").withColumn("src", F.lit(2))
    return only_first.unionByName(only_second)


def merge_complete(first: DataFrame, second: DataFrame, min_distance: float | None = MIN_DISTANCE) -> DataFrame:
    """Both file lists of two complete rankings in one aggregation.

    Gives what ``dedupe_basename``, ``common_files`` and ``unique_files`` give
    together. The score falls with the distance, so the last hit of a base name
    is its largest distance and no rank is needed; numeric maxima and minima
    combine on the map side, which takes the weight off popular base names.
    ``kept`` is false where no hit of the file passed the threshold, so that a
    section without results is still known.
    """
    d = F.when(passes(min_distance), F.col("distance"))

    def side(hits: DataFrame, one: bool) -> DataFrame:
        none = F.lit(None).cast("double")
        return hits.select(
            *KEY,
            "first_row",
            base_name(F.col("path")).alias("file_name"),
            (d if one else none).alias("d1"),
            (none if one else d).alias("d2"),
        )

    return merge_distances(side(first, True).unionByName(side(second, False)))


def merge_distances(pairs: DataFrame) -> DataFrame:
    """``merge_complete`` from rows that hold the distances in both models as far as they count, ``d1`` and ``d2``."""
    merged = pairs.groupBy(*KEY, "first_row", "file_name").agg(
        F.min("d1").alias("near1"), F.max("d1").alias("far1"), F.min("d2").alias("near2"), F.max("d2").alias("far2")
    )
    both = F.col("far1").isNotNull() & F.col("far2").isNotNull()
    return merged.select(
        *KEY,
        "first_row",
        F.when(both, "common_files").otherwise("only_one_model").alias("kind"),
        F.when(F.col("far1").isNotNull(), 1).otherwise(2).alias("src"),
        F.coalesce("near1", "near2").alias("near"),
        "file_name",
        F.when(both, (score(F.col("far1")) + score(F.col("far2"))) / 2)
        .otherwise(score(F.coalesce("far1", "far2")))
        .alias("score"),
        (F.col("far1").isNotNull() | F.col("far2").isNotNull()).alias("kept"),
    )
