"""Exact neighbours from a written index whose rings are skipped by the triangle inequality.

Every file belongs to the pivot it makes the least angle with. The files of a
repository and pivot are cut into rings by that angle. A query at angle ``a``
to the pivot is at least ``a - high`` or ``low - a`` away from all files of a
ring between ``low`` and ``high``; when its ``k`` best so far are nearer, the
ring is skipped unscored. Rings lie in the files from the inside out, so that
the first ones give every query near files and the others have something to be
measured by. The index is scanned where it lies, once for each bounded part of
the queries, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceline.operators.knn import (
    BROADCAST_BYTES,
    PENDING,
    UNIT,
    best_of_scopes,
    keep_best,
    out_schema,
    query_parts,
    unit_matrix,
)
from traceline.operators.ranking import number_rows
from traceline.runtime import stored

PIVOTS = 64
SAMPLE = 2048  # files of which the pivots are chosen
RING_ROWS = 256
_SLACK = 1e-7  # angles are compared with this much room for rounding


@dataclass(frozen=True)
class PivotIndex:
    """``files`` with ``_pivot``, ``_ring`` and ``_angle`` beside their own columns, and the pivots as rows."""

    files: DataFrame
    pivots: np.ndarray


def choose_pivots(index: DataFrame, dim: int, count: int = PIVOTS) -> np.ndarray:
    """Unit vectors of a sample that are far from each other.

    The sample is the ``SAMPLE`` vectors with the least hash; it is all that
    reaches the driver, and whatever it holds the search stays exact.
    """
    sample = index.where(F.col("embedding").isNotNull()).select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).toArrow()
    units = unit_matrix(sample.column("embedding"), dim) if sample.num_rows else np.zeros((0, dim))
    units = units[~np.isnan(units[:, 0])]
    if not len(units):
        return np.eye(1, dim)
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(count, len(units)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break  # what is left are copies of pivots
        chosen.append(far)
        nearest = np.maximum(nearest, units @ units[far])
    return units[chosen]


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1, 1))


def build_pivots(
    index: DataFrame, dim: int, scope: list[str], keep: list[str], count: int = PIVOTS, ring_rows: int = RING_ROWS, path: str | None = None
) -> PivotIndex:
    """Write the rings of ``index`` (under ``path`` to be read again) and give the index."""
    pivots = choose_pivots(index, dim, count)
    files = index.where(F.col("embedding").isNotNull()).select(*scope, "idx", *keep, "embedding")

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_matrix(batch.column("embedding"), dim)
            alive = np.flatnonzero(~np.isnan(units[:, 0]))
            angles = _angles(units[alive], pivots)
            rows = batch.take(pa.array(alive))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(angles.argmin(axis=1).astype(np.int32)), pa.array(angles.min(axis=1, initial=np.inf))],
                names=[*rows.schema.names, "_pivot", "_angle"],
            )

    schema = T.StructType([*files.schema, T.StructField("_pivot", T.IntegerType()), T.StructField("_angle", T.DoubleType())])
    placed = stored(files.mapInArrow(assign, schema), "assigned")
    seated = number_rows(placed, [*scope, "_pivot"], ["_angle", "idx"], "_seat", start=0)
    ringed = seated.withColumn("_ring", F.floor(F.col("_seat") / ring_rows)).drop("_seat")
    order = [*scope, "_ring", "_pivot", "_angle"]
    laid = ringed.repartition(*scope, "_ring", "_pivot").sortWithinPartitions(*order)
    if path is None:
        return PivotIndex(stored(laid, "rings"), pivots)
    laid.write.parquet(f"{path}/rings")
    rows = [(i, [float(c) for c in p]) for i, p in enumerate(pivots)]
    index.sparkSession.createDataFrame(rows, "pivot int, direction array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    return read_pivots(index.sparkSession, path)


def read_pivots(spark: SparkSession, path: str) -> PivotIndex:
    rows = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
    return PivotIndex(spark.read.parquet(f"{path}/rings"), np.array([r.direction for r in rows]))


def _runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one value in all ``columns``."""
    change = np.zeros(batch.num_rows, dtype=bool)
    for name in columns:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    starts = [0, *np.flatnonzero(change).tolist()] if batch.num_rows else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def nearest_pivots(
    index: PivotIndex,
    queries: DataFrame,
    k: int,
    dim: int,
    scope: list[str] | None = None,
    by: list[str] | None = None,
    keep: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    rings: tuple[Accumulator, Accumulator] | None = None,
) -> DataFrame:
    """As ``knn.nearest``, from an index in rings. ``rings`` counts pairs of a ring and a query, all and skipped ones."""
    scope = ["repo_id"] if scope is None else scope
    by = ["section_name"] if by is None else by
    keep = ["path"] if keep is None else keep
    pivots, files = index.pivots, index.files
    schema = out_schema(files, queries, scope, by, keep)

    def search(files: DataFrame, matrix: pa.Table) -> DataFrame:
        units = unit_matrix(matrix.column("embedding"), dim)
        alive = np.flatnonzero(~np.isnan(units[:, 0]))
        # One part of the queries at a time: angles to the pivots and the best so far are held for all of it.
        shared = files.sparkSession.sparkContext.broadcast((units[alive], matrix.select(by).combine_chunks().take(pa.array(alive)), pivots))

        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asks, names, directions = shared.value
            yield from keep_best(_scored(batches, asks, names, directions), k, [*scope, *by], max(PENDING, 4 * k * len(asks)))

        return files.select(*scope, "idx", *keep, "embedding", "_pivot", "_ring", "_angle").mapInArrow(task, schema)

    def _scored(batches: Iterable[pa.RecordBatch], asks: np.ndarray, names: pa.Table, directions: np.ndarray) -> Iterator[pa.RecordBatch]:
        away = _angles(asks, directions)
        here, best = None, np.zeros(0)
        for batch in batches:
            for run in _runs(batch, [*scope, "_ring", "_pivot"]):
                at = tuple(run.column(c)[0].as_py() for c in scope)
                if here is None or at != here:
                    # ``k`` best cosines of each query in this repository, as far as this task has seen.
                    here, best = at, np.full((len(asks), k), -np.inf)
                angle, pivot = run.column("_angle").to_numpy(), run.column("_pivot")[0].as_py()
                bound = np.maximum(away[:, pivot] - angle.max(), angle.min() - away[:, pivot]) - _SLACK
                reach = np.where(np.isinf(best[:, 0]), np.inf, np.arccos(np.clip(best[:, 0], -1, 1)) + _SLACK)
                wanted = np.flatnonzero(bound <= reach)
                if rings is not None:
                    rings[0].add(len(asks))
                    rings[1].add(len(asks) - len(wanted))
                if not len(wanted):
                    continue
                vectors = unit_matrix(run.column("embedding"), dim)
                for start in range(0, len(wanted), BLOCK_QUERIES):
                    some = wanted[start : start + BLOCK_QUERIES]
                    sims = np.rint(asks[some] @ vectors.T * UNIT).astype(np.int64)
                    query, column = best_of_scopes(sims, run.column("idx").to_numpy(), k)
                    top = np.full((len(some), k), -np.inf)
                    found = sims[query, column] / UNIT
                    width = len(query) // len(some)
                    top[:, :width] = found.reshape(len(some), width)
                    best[some] = np.sort(np.concatenate([best[some], top], axis=1), axis=1)[:, -k:]
                    # Finds that are already beaten need not be passed on; ties may win by their place.
                    good = found >= best[some[query], 0]
                    rows = run.take(pa.array(column[good]))
                    asked = names.take(pa.array(some[query[good]]))
                    columns = [rows.column(c) for c in [*scope, "idx", *keep]] + [c.combine_chunks() for c in asked.columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found[good])], names=schema.names)

    return query_parts(files, queries, k, dim, scope, by, search, broadcast_bytes, written=True)


BLOCK_QUERIES = 4096  # queries scored against a ring at once
