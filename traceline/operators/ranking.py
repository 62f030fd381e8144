"""Dense numbering of rows inside groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceline.runtime import stored

# monotonically_increasing_id puts the partition above bit 33, the row below.
_ROW_BITS = 33


def number_rows(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    into: str,
    start: int = 1,
) -> DataFrame:
    """Number the rows of each group from ``start`` in the given order.

    A window over the group would sort one group in one task. Here the rows are
    range-partitioned on group and order together, so a group spreads over as
    many partitions as it needs; the number is the place inside the partition
    plus the rows of the group in earlier partitions. ``order`` must be unique
    within a group. The sorted rows are written once, because both the counts
    and the numbering must see the same partitions. Sampling the ranges reads
    ``df`` a second time: write it first if it is costly to make.
    """
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    laid = stored(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_seat", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_seat", _ROW_BITS)),
        "sorted",
    )
    # At most one row per group and partition it touches.
    counts = laid.groupBy(*group, "_pid").agg(F.count("*").alias("_n"), F.min("_seat").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored(
        counts.select(
            *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
            F.col("_pid").alias("_p"),
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + start).alias("_shift"),
        ),
        "offsets",
    )
    same = [F.col("_pid") == F.col("_p")] + [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return laid.join(shifts, reduce(Column.__and__, same)).select(
        *df.columns, (F.col("_seat") + F.col("_shift")).alias(into)
    )


def number_files(files: DataFrame, scope: list[str] | None = None, order: list[str | Column] | None = None) -> DataFrame:
    """Dense 0-based ``idx`` per repository in input order."""
    return number_rows(files, scope or ["repo_id"], order or ["pos"], "idx", start=0)
