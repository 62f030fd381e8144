"""Connected components of links held in a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceline.runtime import stored


def local_forest(size: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(node, smallest node of its component)`` that join what the given links join."""
    label = np.arange(size)
    while len(left):
        lower = label.copy()
        np.minimum.at(lower, left, label[right])
        np.minimum.at(lower, right, label[left])
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    node = np.flatnonzero(label != np.arange(size))
    return node, label[node]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (long) that is not its own root.

    The root is the smallest node of the component. Large and small stars
    alternate: each node hangs its larger, then its smaller neighbours on the
    smallest one, until nothing changes. Every round is written, so no lineage
    builds up; only a count and a checksum reach the driver. Rows with NULL or
    equal ends are no links.
    """
    edges = stored(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
