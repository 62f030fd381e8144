"""Exact greatest inner products by buckets of vector length.

Candidates are sorted by falling length and cut into buckets of equal size, so
the vectors of a bucket have about one length; queries are grouped by the
length they ask for. A query whose ``k``-th best score so far is ``s`` needs
from a bucket whose longest vector has length ``m`` a cosine of at least
``s / (|q| m)``, its local threshold. Above 1 the bucket is skipped. A high
threshold leaves narrow intervals for the coordinates of a candidate, so the
sorted lists of the query's greatest coordinates give few candidates; below it
the candidates too short for the query are left out. What remains is verified
by whole products.

The thresholds come from a first round over about the square root of the
number of buckets, the longest vectors first; a second round does the rest.
Each pair of a query group and a bucket is one bounded task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceline.llm.whitening import finite
from traceline.operators.ranking import number_rows
from traceline.runtime import stored

K = 20
SCALE = 64
BUCKET = 16_384  # candidates of a bucket
GROUP = 8_192  # queries of a group
CELLS = 2_000_000  # products held at once in a task
FOCUS = 3  # coordinates whose lists are looked at
STEEP = 0.9  # local threshold from which coordinates are used
_SLACK = 1e-9  # bounds are widened by this share against rounding
_LARGEST = 2.0**62  # squared lengths stay below, so every product is a long

FOUND = "qn long, vec_id long, score long"


def whole_vectors(df: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """``vec_id, x, norm2``: whole multiples and squared length of every finite vector that has a key."""
    multiples = F.transform(vector, lambda c: c.cast("double") * scale)
    squares = F.aggregate(multiples, F.lit(0.0), lambda acc, c: acc + F.pow(c, 2))
    large = F.raise_error(F.lit("a scaled vector is too long: its products may exceed 64 bits"))
    whole = F.when(squares < _LARGEST / 2, F.transform(multiples, lambda c: F.floor(c))).otherwise(large.cast("array<bigint>"))
    return (
        df.where(finite(vector) & F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("vec_id"), whole.alias("x"))
        .withColumn("norm2", F.aggregate("x", F.lit(0).cast("long"), lambda acc, c: acc + c * c))
    )


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """Rows of a list column; shorter rows end in zeros."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(sizes), width), dtype=kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _exact_kind(longest2: float) -> type:
    """The narrowest type in which sums of products up to ``longest2`` are exact.

    Every partial sum is at most the product of the lengths.
    """
    return np.float32 if longest2 < 2**24 else np.float64 if longest2 < 2**53 else np.int64


def _firsts(scores: np.ndarray, alive: np.ndarray, by_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best alive cells of each row; ties go to the earlier in ``by_id``."""
    counts = alive.sum(axis=1)
    few = np.flatnonzero(counts <= k)
    rows, columns = np.nonzero(alive[few])
    out = [(few[rows], columns)]
    many = np.flatnonzero(counts > k)
    if len(many):
        lowest = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
        held = np.where(alive[many], scores[many], lowest)[:, by_id]
        bound = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k, None]
        above = held > bound
        level = held == bound
        level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
        rows, columns = np.nonzero(above | level)
        out.append((many[rows], by_id[columns]))
    return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])


def _own_cells(own: np.ndarray, ids: np.ndarray, by_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the candidates that have the key of the query; a key may be repeated."""
    a, b = (np.searchsorted(ids[by_id], own, side=side) for side in ("left", "right"))
    row = np.repeat(np.arange(len(own)), b - a)
    place = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    return row, by_id[place]


def by_length(
    asks: np.ndarray,
    own: np.ndarray,
    least: np.ndarray,
    need: np.ndarray,
    given: np.ndarray,
    length: np.ndarray,
    ids: np.ndarray,
    k: int,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidate, score) of the best, leaving out candidates shorter than a query needs.

    ``given`` is sorted by falling ``length``, so they are the end of the bucket.
    """
    step = max(1, CELLS // len(given))
    order = np.argsort(need, kind="stable")
    by_id = np.argsort(ids, kind="stable")
    for start in range(0, len(order), step):
        part = order[start : start + step]
        reach = int(np.searchsorted(-length, -need[part].min() * (1 - _SLACK), side="right"))
        if not reach:
            continue
        scores = asks[part] @ given[:reach].T
        alive = scores >= least[part, None]
        row, column = _own_cells(own[part], ids, by_id)
        alive[row[column < reach], column[column < reach]] = False
        row, column = _firsts(scores, alive, by_id[by_id < reach], k)
        yield part[row], column, scores[row, column]


def by_coordinate(
    asks: np.ndarray,
    own: np.ndarray,
    least: np.ndarray,
    cosine: np.ndarray,
    given: np.ndarray,
    length: np.ndarray,
    ids: np.ndarray,
    k: int,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for queries with a high local threshold ``cosine``.

    If a unit vector has a cosine of at least ``t`` with the unit query ``u``,
    its coordinate ``f`` lies within ``sqrt((1 - u_f^2)(1 - t^2))`` of ``u_f t``
    or between that and ``u_f``'s own side, up to 1 where ``|u_f| >= t``.
    """
    units = given / np.where(length == 0, 1, length)[:, None]
    lists = np.argsort(units, axis=0, kind="stable")
    values = np.take_along_axis(units, lists, axis=0)
    for i, ask in enumerate(asks):
        u, t = ask / np.linalg.norm(ask.astype(np.float64)), min(cosine[i], 1.0) * (1 - _SLACK)
        focus = np.argsort(-np.abs(u), kind="stable")[:FOCUS]
        spread = np.sqrt(np.maximum(0, (1 - u[focus] ** 2) * (1 - t * t)))
        low = np.where(u[focus] <= -t, -1.0, u[focus] * t - spread) - _SLACK
        high = np.where(u[focus] >= t, 1.0, u[focus] * t + spread) + _SLACK
        a = [np.searchsorted(values[:, f], lo, side="left") for f, lo in zip(focus, low)]
        b = [np.searchsorted(values[:, f], hi, side="right") for f, hi in zip(focus, high)]
        best = int(np.argmin(np.subtract(b, a)))
        rows = lists[a[best] : b[best], focus[best]]
        near = units[np.ix_(rows, focus)]
        rows = rows[((near >= low) & (near <= high)).all(axis=1)]
        rows = rows[ids[rows] != own[i]]
        scores = given[rows] @ ask
        rows, scores = rows[scores >= least[i]], scores[scores >= least[i]]
        if len(rows) > k:
            chosen = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[chosen], scores[chosen]
        yield np.full(len(rows), i), rows, scores


def search_bucket(given: pa.Table, asks: pa.Table, k: int, steep: float = STEEP) -> pa.Table:
    """``qn, vec_id, score``: the best of one bucket for one group of queries that are no worse than ``least``."""
    empty = pa.table({"qn": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    if not given.num_rows or not asks.num_rows:
        return empty
    width = max(int(np.max(t.column("x").combine_chunks().value_lengths().to_numpy(zero_copy_only=False), initial=0)) for t in (given, asks))
    ids, qn, own = (t.column(c).to_numpy() for t, c in ((given, "vec_id"), (asks, "qn"), (asks, "vec_id")))
    length, asked = (np.sqrt(t.column("norm2").to_numpy().astype(np.float64)) for t in (given, asks))
    order = np.argsort(-length, kind="stable")
    ids, length = ids[order], length[order]
    kind = _exact_kind(max(length[0], asked.max()) ** 2 * (1 + _SLACK))
    left, right = _matrix(asks.column("x"), width, kind), _matrix(given.column("x"), width, kind)[order]
    floor = asks.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
    known = ~np.isnan(floor)
    floor = np.where(known, floor, 0.0)
    need = np.where(floor > 0, floor / np.where(asked == 0, 1, asked), 0.0)
    cosine = need / max(length[0], 1e-300)
    # A score that a double cannot hold may have been rounded up.
    least = np.where(known, floor - np.where(np.abs(floor) >= 2**53, np.abs(floor) * _SLACK, 0), -np.inf)
    use = cosine <= 1 + _SLACK
    steeply = use & (cosine >= steep) & (cosine > 0)
    found = []
    for method, bound, rows in ((by_length, need, np.flatnonzero(use & ~steeply)), (by_coordinate, cosine, np.flatnonzero(steeply))):
        if len(rows):
            for row, column, score in method(left[rows], own[rows], least[rows], bound[rows], right, length, ids, k):
                found.append((qn[rows[row]], ids[column], score.astype(np.int64)))
    if not found:
        return empty
    q, c, s = (np.concatenate(part) for part in zip(*found))
    return pa.table({"qn": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.int64())})


def _search(given: DataFrame, asks: DataFrame, buckets: range, task: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """Every bucket in ``buckets`` against every group of queries that may find something in it."""
    spans = given.groupBy("bucket").agg(F.max("norm2").alias("longest2"))
    groups = asks.groupBy("grp").agg(F.min(F.coalesce(_needed(), F.lit(0.0))).alias("needed"))
    numbers = F.sequence(F.lit(buckets.start), F.lit(buckets.stop - 1)) if len(buckets) else F.array()
    # One row per bucket and group, a small fraction of the rows of either table.
    reach = F.sqrt(F.col("longest2").cast("double")) * (1 + _SLACK)
    asked = groups.select("grp", "needed", F.explode(numbers.cast("array<bigint>")).alias("bucket"))
    pairs = stored(asked.join(spans, "bucket").where(reach >= F.col("needed")).select("bucket", "grp"), "bucket-pairs")
    left = given.join(pairs, "bucket").select("bucket", "grp", "vec_id", "x", "norm2")
    right = asks.join(pairs, "grp").select("bucket", "grp", "qn", "vec_id", "x", "norm2", F.col("least").cast("double").alias("least"))
    on = ["bucket", "grp"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(task, FOUND)


def _needed() -> Column:
    """Length a candidate must have to reach the query's least score."""
    return F.when((F.col("least") > 0) & (F.col("norm2") > 0), F.col("least") / F.sqrt(F.col("norm2").cast("double")))


def _grouped(asks: DataFrame, group: int) -> DataFrame:
    """Queries in groups of alike needed lengths."""
    ranked = number_rows(asks.withColumn("_need", F.coalesce(_needed(), F.lit(0.0))), [], ["_need", "qn"], "_at", start=0)
    return stored(ranked.withColumn("grp", F.floor(F.col("_at") / group)).drop("_need", "_at"), "asks")


def _best(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("qn").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def top_products(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = K,
    scale: int = SCALE,
    key: str = "vec_id",
    vector: str = "embedding",
    bucket: int = BUCKET,
    group: int = GROUP,
    steep: float = STEEP,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` greatest inner products of each query with rows of another key.

    Components become ``floor(scale * c)``, so scores are whole numbers and
    ties go to the smaller key. Vectors that are NULL or hold NULL or
    non-finite components, and rows without a key, take no part. A vector that
    is shorter than another counts as ending in zeros. Repeated candidate rows
    are candidates of their own; equal rows of the queries are asked once, and
    two different vectors of one query key give two lists. With fewer than
    ``k`` candidates all are returned. Vectors whose products could exceed 64
    bits raise. Only ``key`` and ``vector`` are read.
    """
    given = number_rows(
        stored(whole_vectors(candidates, scale, key, vector), "vectors"), [], [F.col("norm2").desc(), "vec_id", "x"], "at", start=0
    )
    given = stored(given.select("vec_id", "x", "norm2", F.floor(F.col("at") / bucket).alias("bucket")), "given")
    asked = stored(whole_vectors(queries, scale, key, vector).distinct(), "queries")
    asked = number_rows(asked, [], ["vec_id", "x"], "qn")
    buckets = (given.agg(F.max("bucket")).first()[0] or 0) + 1
    first = math.isqrt(buckets - 1) + 1 if buckets > 1 else 1

    def task(given: pa.Table, asks: pa.Table) -> pa.Table:
        return search_bucket(given, asks, k, steep)

    asks = _grouped(asked.withColumn("least", F.lit(None).cast("long")), group)
    pilot = stored(_best(_search(given, asks, range(first), task), k), "first-round")
    least = pilot.where(F.col("rank") == k).select("qn", F.col("score").alias("least"))
    asks = _grouped(asks.drop("least", "grp").join(least, "qn", "left"), group)
    rest = _search(given, asks, range(first, buckets), task)
    best = _best(pilot.drop("rank").unionByName(rest), k)
    ids = asks.select("qn", F.col("vec_id").alias("query_id"))
    return best.join(ids, "qn").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
