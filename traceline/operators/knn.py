"""Nearest neighbours in angular distance.

Vectors are scored as matrix products inside Arrow batches. A task keeps the
best ``k`` files per query and scope and drops the rest, so the pairs never
become rows; a window then picks the best ``k`` over all tasks. Single-precision
products, with more room than their error, sort out the pairs that are below
the ``k`` best a task has so far; all others are scored in double. Where many
queries are asked, near files are put in leaves, and a leaf whose bounds keep
all of it below a query's best is not multiplied for it. Cosines are
rounded to nine decimals, which makes equal vectors equal whatever the order
of summation; ties are then settled by ``idx``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from traceline.functions.scoring import angular_distance
from traceline.operators.ranking import number_rows
from traceline.runtime import stored

UNIT = 10**9  # cosines are compared as whole multiples of 1e-9
CELLS = 4_000_000  # scores held at once in a task
PENDING = 500_000  # finds held back in a task
LOOSE_BATCHES = 256  # small batches of finds that wait before they become one
PARTS_AT_ONCE = 4  # parts of the queries that are worked off side by side
PART_QUERIES = 4096  # queries of a part at least, however many neighbours they ask for
FIRST_FILES, MOST_FILES = 256, 2048  # files whose scores are looked at once
ROUND_CELLS = 2**20  # scores looked at once
LEAF_QUERIES = 8192  # queries from which on files are put in leaves
LEAF_ROWS = 512  # files of a leaf at most
LEAF_CELLS = 2**21  # vector components put in leaves at once, unless a batch has more
LEAF_AXES = 4  # directions in which leaves are bounded
LEAF_STRIDE = 16  # leaves between one and the next that is looked at
BAR_CELLS = 2_000_000  # best cosines remembered in a task
BROADCAST_BYTES = 64 * 2**20  # largest query matrix sent to every executor
BLOCK_CELLS = 2**22  # vector components in one block of the blocked join
SIDE_BLOCKS = 8  # blocks of a side of the blocked join, unless they would be too large
FULL_BLOCK_ROWS = 1024  # block side when every pair is part of the result


def unit_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors; a wrong length raises."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) and set(pc.unique(pc.list_value_length(column)).to_pylist()) != {dim}:
        raise ValueError(f"dimension mismatch: the index must hold vectors of {dim}")
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(invalid="ignore", divide="ignore"):
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows


def _scope_codes(table: pa.RecordBatch | pa.Table, scope: list[str]) -> np.ndarray:
    codes = np.zeros(table.num_rows, dtype=np.int64)
    for name in scope:
        column = table.column(name)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        part = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        codes = codes * (int(part.max(initial=0)) + 1) + part
        codes = np.unique(codes, return_inverse=True)[1]
    return codes


def _members(codes: np.ndarray, usable: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each scope, unusable rows left out."""
    rows = np.flatnonzero(usable)
    if not len(rows):
        return []
    rows = rows[np.argsort(codes[rows], kind="stable")]
    return np.split(rows, np.flatnonzero(np.diff(codes[rows])) + 1)


def best_of_scopes(sims: np.ndarray, idx: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of the best ``k`` columns of each row; all of them for None."""
    queries, width = sims.shape
    if k is None or width <= k:
        return np.repeat(np.arange(queries), width), np.tile(np.arange(width), queries)
    # One integer per cell: similarity above, place by idx below, so no ties.
    place = np.empty(width, dtype=np.int64)
    place[np.argsort(idx, kind="stable")] = np.arange(width)
    keys = (sims << 31) + (width - place)
    top = np.argpartition(keys, width - k, axis=1)[:, width - k :]
    return np.repeat(np.arange(queries), k), top.ravel()


class Bars:
    """For each scope the ``k`` best cosines of every query so far, in whole multiples of 1e-9.

    What is below the ``k``-th of them cannot be in the result. A task with more
    scopes than ``BAR_CELLS`` allows forgets the oldest, and passes on more.
    """

    def __init__(self, k: int, queries: int):
        self.k, self.queries, self.scopes = k, queries, {}

    def of(self, scope: tuple) -> np.ndarray:
        if scope not in self.scopes:
            while self.scopes and (len(self.scopes) + 1) * self.queries * self.k > BAR_CELLS:
                del self.scopes[next(iter(self.scopes))]
            self.scopes[scope] = np.full((self.queries, self.k), -(2**40), dtype=np.int64)
        return self.scopes[scope]


def _best_rows(query: np.ndarray, idx: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which finds are among the ``k`` best of their query, by query, and their places there."""
    order = np.lexsort((idx, -sims, query))
    codes = query[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes)))
    return order[place < k], place[place < k]


def _promising(rows: np.ndarray, files: np.ndarray, bars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(query, file) of all pairs that may reach the bars, in single precision; None if they are many."""
    # A query's products lie in a column, so that their maxima are taken row by row.
    near = np.matmul(files, rows.T, out=room[: len(rows) * len(files)].reshape(len(files), len(rows)))
    low = _low(bars, rows.shape[1])
    hot = np.flatnonzero(near.max(axis=0, initial=-np.inf) >= low)
    if len(hot) * len(files) > near.size // 2:
        file, query = np.divmod(np.flatnonzero(near >= low), len(rows))
    else:
        file, query = np.divmod(np.flatnonzero(near[:, hot] >= low[hot]), max(1, len(hot)))
        query = hot[query]
    return (query, file) if len(query) <= near.size // 16 else None


class Asks:
    """The query matrix of a task in the forms its products need."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.small = matrix, matrix.astype(np.float32)
        self.axes = None

    def take_axes(self, files: np.ndarray) -> None:
        """Bound leaves along the directions in which these files are strongest; any would do."""
        self.axes = np.linalg.eigh(files.T @ files)[1][:, ::-1][:, :LEAF_AXES]
        seen = _seen(self.matrix, self.axes)
        self.signs = np.concatenate([np.maximum(seen, 0), np.minimum(seen, 0)], axis=1).astype(np.float32)


def _seen(vectors: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates of unit vectors along ``axes``, and the length of what is left of them.

    The product of two vectors is at most that of these.
    """
    along = vectors @ axes
    rest = np.sqrt(np.maximum(0, 1 - np.square(along).sum(axis=1)))
    return np.column_stack([along, rest])


def _leaves(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Numbers of the points in groups of at most ``rows``, halved along the direction in which they differ most."""
    waiting, leaves = [np.arange(len(points))], []
    while waiting:
        members = waiting.pop()
        if len(members) <= rows:
            leaves.append(members)
            continue
        part, half = points[members], len(members) // 2
        order = np.argpartition(part[:, part.var(axis=0).argmax()], half)
        waiting += [members[order[:half]], members[order[half:]]]
    return leaves


def _low(bars: np.ndarray, dim: int) -> np.ndarray:
    """What a product in single precision reaches at least when the true one reaches the bar."""
    # A sum of products of unit vectors is off by less than this.
    return (bars / UNIT - (dim + 16) * 2.0**-23).astype(np.float32)


#: Numbers of files, and which queries with these bars may find something among them; None for all.
Round = tuple[np.ndarray | slice, Callable[[np.ndarray], np.ndarray | None]]


def _in_order(asks: Asks, files: np.ndarray) -> Iterator[Round]:
    """Files in rounds that grow, for all queries."""
    start, width = 0, FIRST_FILES
    while start < len(files):
        end = min(len(files), start + width)
        if len(files) - end < FIRST_FILES and len(files) - start <= MOST_FILES:
            end = len(files)
        yield slice(start, end), lambda bars: None
        start, width = end, min(MOST_FILES, 2 * width)


def _by_leaf(asks: Asks, files: np.ndarray) -> Iterator[Round]:
    """A few files from everywhere for all queries, then leaf by leaf for those that the leaf's bounds allow."""
    if asks.axes is None:
        asks.take_axes(files)
    first = np.zeros(len(files), dtype=bool)
    first[:: max(1, len(files) // FIRST_FILES)] = True
    yield np.flatnonzero(first), lambda bars: None
    rest = np.flatnonzero(~first)
    seen = _seen(files, asks.axes)[rest]
    leaves = _leaves(seen, LEAF_ROWS)
    # Neighbours are far apart in this order, so that every query soon has near files to measure the others by.
    for i in (i for start in range(LEAF_STRIDE) for i in range(start, len(leaves), LEAF_STRIDE)):
        box = seen[leaves[i]]
        corner = np.concatenate([box.max(axis=0), box.min(axis=0)]).astype(np.float32)
        # Coordinates, corners and their products are rounded as well.
        yield rest[leaves[i]], lambda bars: np.flatnonzero(asks.signs @ corner + 2.0**-16 >= _low(bars, files.shape[1]))


def _finds(asks: Asks, files: np.ndarray, idx: np.ndarray, best: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, file, cosine) of the pairs that are among the ``k`` best so far; ``best`` is brought up to date."""
    matrix, small = asks.matrix, asks.small
    light = files.astype(np.float32)
    room = np.empty(min(ROUND_CELLS, len(files) * len(matrix)), dtype=np.float32)
    leafy = len(matrix) >= LEAF_QUERIES and len(files) >= 4 * LEAF_ROWS and np.isfinite(files).all()
    rounds, numbers, places = _by_leaf if leafy else _in_order, np.arange(len(matrix)), np.arange(len(files))
    for members, reach in rounds(asks, files):
        part, light_part, part_idx = files[members], light[members], idx[members]
        wanted = reach(best[:, 0])
        step = max(1, ROUND_CELLS // len(part))
        for first in range(0, len(matrix) if wanted is None else len(wanted), step):
            some = slice(first, first + step) if wanted is None else wanted[first : first + step]
            bar = best[some]
            rows = small[some] if wanted is None else small.take(some, axis=0)
            # Bars that nothing has been held against yet let everything through.
            pairs = _promising(rows, light_part, bar[:, 0], room) if bar[:, 0].min() > -UNIT * 2 else None
            if pairs is None:
                sims = np.rint(matrix[some] @ part.T * UNIT).astype(np.int64)
                query, file = best_of_scopes(sims, part_idx, k)
                sims = sims[query, file]
            else:
                query, file = pairs
                sims = np.rint(np.einsum("ij,ij->i", matrix[numbers[some][query]], part[file]) * UNIT).astype(np.int64)
            # Ties may win by their place.
            good = np.flatnonzero(sims >= bar[query, 0])
            if not len(good):
                continue
            query, file, sims = query[good], file[good], sims[good]
            kept, place = _best_rows(query, part_idx[file], sims, k)
            query, file, sims = query[kept], file[kept], sims[kept]
            asked, at = np.unique(query, return_inverse=True)
            found = np.full((len(asked), k), -(2**40), dtype=np.int64)
            found[at, place] = sims
            best[numbers[some][asked]] = np.sort(np.concatenate([bar[asked], found], axis=1), axis=1)[:, -k:]
            yield numbers[some][query], places[members][file], sims


def _gathered(parts: Iterable[tuple[np.ndarray, ...]], rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same arrays in runs of about ``rows``."""
    waiting, held = [], 0
    for part in parts:
        waiting.append(part)
        held += len(part[0])
        if held >= rows:
            yield tuple(np.concatenate(p) for p in zip(*waiting))
            waiting, held = [], 0
    if waiting:
        yield tuple(np.concatenate(p) for p in zip(*waiting))


def score_table(
    table: pa.RecordBatch | pa.Table,
    matrix: np.ndarray,
    names: pa.Table,
    k: int | None,
    scope: list[str],
    keep: list[str],
    bars: Bars | None = None,
    asks: Asks | None = None,
) -> Iterator[pa.RecordBatch]:
    """Score one bounded piece of the index against a bounded query matrix.

    For None all pairs are given, in chunks of ``CELLS`` scores. Otherwise it is
    those that are among the best ``k`` of what ``bars`` have seen, which may be
    more than ``k`` a query. ``asks`` is made of the matrix.
    """
    files = unit_matrix(table.column("embedding"), matrix.shape[1])
    idx = table.column("idx").to_numpy()
    groups = _members(_scope_codes(table, scope), ~np.isnan(files[:, 0]))

    def rows(query: np.ndarray, picked: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
        data = [table.column(c).take(pa.array(picked)) for c in [*scope, "idx", *keep]]
        data += [c.take(pa.array(query)) for c in names.columns]
        data.append(pa.array(sims / UNIT))
        data = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in data]
        return pa.RecordBatch.from_arrays(data, names=[*scope, "idx", *keep, *names.column_names, "cos_sim"])

    if not len(matrix):
        return
    if k is None:
        step = max(1, CELLS // max(1, table.num_rows))
        for members in groups:
            for start in range(0, matrix.shape[0], step):
                sims = np.rint(matrix[start : start + step] @ files[members].T * UNIT).astype(np.int64)
                query, column = best_of_scopes(sims, idx[members], None)
                yield rows(start + query, members[column], sims.ravel())
        return
    bars = bars or Bars(k, len(matrix))
    asks = asks or Asks(matrix)

    def found() -> Iterator[tuple[np.ndarray, ...]]:
        for members in groups:
            best = bars.of(tuple(table.column(c)[int(members[0])].as_py() for c in scope))
            all_rows = len(members) == len(files) and not scope
            for query, column, sims in _finds(asks, files if all_rows else files[members], idx if all_rows else idx[members], best, k):
                yield query, members[column], sims

    for query, picked, sims in _gathered(found(), PENDING // 8):
        yield rows(query, picked, sims)


def still_best(found: pa.Table, k: int, key: list[str]) -> pa.Table:
    """The best ``k`` rows of each key."""
    codes = _scope_codes(found, key)
    order = np.lexsort((found.column("idx").to_numpy(), -found.column("cos_sim").to_numpy(), codes))
    codes = codes[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes)))
    return found.take(pa.array(order[place < k])).combine_chunks()


def keep_best(parts: Iterable[pa.RecordBatch], k: int, key: list[str], pending: int) -> Iterator[pa.RecordBatch]:
    """Reduce the finds of a task to ``k`` per key before they leave Python.

    At most about ``pending`` rows wait; when hardly any of them can be
    dropped, as with many small repositories, they are passed on as they are.
    """
    waiting: list[pa.RecordBatch] = []
    loose: list[pa.RecordBatch] = []
    rows = 0
    for part in parts:
        # A batch of a few rows takes as much memory as one of hundreds.
        loose.append(part)
        rows += part.num_rows
        if len(loose) >= LOOSE_BATCHES or rows > pending:
            waiting += pa.Table.from_batches(loose).combine_chunks().to_batches()
            loose = []
        if rows > pending:
            best = still_best(pa.Table.from_batches(waiting), k, key)
            if best.num_rows > pending // 2:
                yield from best.to_batches()
                waiting, rows = [], 0
            else:
                waiting, rows = best.to_batches(), best.num_rows
    waiting += loose
    if waiting:
        yield from still_best(pa.Table.from_batches(waiting), k, key).to_batches()


def out_schema(index: DataFrame, queries: DataFrame, scope: list[str], by: list[str], keep: list[str]) -> T.StructType:
    fields = [index.schema[c] for c in [*scope, "idx", *keep]] + [queries.schema[c] for c in by]
    return T.StructType([*fields, T.StructField("cos_sim", T.DoubleType())])


def _top(found: DataFrame, k: int | None, scope: list[str], by: list[str]) -> DataFrame:
    out = found.withColumn("distance", angular_distance(F.col("cos_sim")))
    if k is None:
        return out
    nearest = Window.partitionBy(*scope, *by).orderBy(F.col("cos_sim").desc(), "idx")
    return out.withColumn("rk", F.row_number().over(nearest)).where(F.col("rk") <= k)


def _columns(index: DataFrame, scope: list[str], keep: list[str]) -> DataFrame:
    return index.where(F.col("embedding").isNotNull()).select(*scope, "idx", *keep, "embedding")


def _pieces(batches: Iterable[pa.RecordBatch], least: int, most: int) -> Iterator[pa.Table]:
    """The same rows in tables of at most ``most``; batches are put together up to ``least`` of them."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            if waiting and held + part.num_rows > max(least, part.num_rows):
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, held = [], 0
            waiting.append(part)
            held += part.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


Task = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def best_task(
    spark: SparkSession, matrix: pa.Table, k: int | None, dim: int, scope: list[str], by: list[str], keep: list[str]
) -> Task:
    """Function for ``mapInArrow`` that scores index rows against the whole (bounded) query matrix.

    Each task gives its ``k`` best per query and scope, or all for None.
    """
    units = unit_matrix(matrix.column("embedding"), dim)
    alive = np.flatnonzero(~np.isnan(units[:, 0]))
    shared = spark.sparkContext.broadcast((units[alive], matrix.select(by).combine_chunks().take(pa.array(alive))))

    # Long vectors are widened to doubles a part of the batch at a time.
    step = max(1, BLOCK_CELLS // dim)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names = shared.value
        bars, asks = (None, None) if k is None else (Bars(k, len(rows)), Asks(rows))
        # Leaves of more files than a batch holds are bounded better.
        least = max(1, LEAF_CELLS // dim) if asks is not None and len(rows) >= LEAF_QUERIES else 1
        found = (part for piece in _pieces(batches, least, step) for part in score_table(piece, rows, names, k, scope, keep, bars, asks))
        yield from found if k is None else keep_best(found, k, [*scope, *by], max(PENDING, 4 * k * len(rows)))

    return task


def query_parts(
    files: DataFrame,
    queries: DataFrame,
    k: int | None,
    dim: int,
    scope: list[str],
    by: list[str],
    search: Callable[[DataFrame, pa.Table], DataFrame],
    broadcast_bytes: int = BROADCAST_BYTES,
    written: bool = False,
) -> DataFrame:
    """Best hits of all queries from ``search``, which takes the files and a matrix of at most about ``broadcast_bytes``.

    Queries that fit are fetched once, and at most one row more than fits to
    find out. Others are dealt by a hash of their key to even parts; each is
    one scan of the index, whose few hits are written before the next begins,
    so that few parts at a time are on the executors. The index is not moved; it
    is written before the first scan, unless it is ``written``, so that what it
    is made from is worked off once. Parts are also small enough for a task to
    hold the best ``k`` of their queries. A few parts are one job, whose tasks
    fill the cores that the last tasks of a single scan would leave idle.
    """
    limit = max(1, broadcast_bytes // (8 * dim))
    if k is not None:
        limit = min(limit, max(PART_QUERIES, PENDING // (4 * k)))
    asks = queries.where(F.col("embedding").isNotNull()).select(*by, "embedding")
    fetched = asks.limit(limit + 1).toArrow()
    if fetched.num_rows <= limit:
        return _top(search(files, fetched), k, scope, by)
    # Parts by a hash are a little uneven; a tenth is left for that.
    asks = stored(asks, "asked")
    parts = -(-asks.count() * 10 // (9 * limit)) + 1
    part = F.pmod(F.xxhash64(*by), F.lit(parts)).alias("_part")
    dealt = stored(asks.select(*by, "embedding", part).repartition("_part"), "queries")
    laid = files if written else stored(files, "index")
    found = []
    for start in range(0, parts, PARTS_AT_ONCE):
        some = [search(laid, dealt.where(F.col("_part") == i).drop("_part").toArrow()) for i in range(start, min(parts, start + PARTS_AT_ONCE))]
        found.append(stored(reduce(DataFrame.unionByName, some), "hits"))
    return _top(reduce(DataFrame.unionByName, found), k, scope, by)


def nearest_grouped(
    index: DataFrame,
    queries: DataFrame,
    k: int | None,
    dim: int,
    scope: list[str],
    by: list[str],
    keep: list[str],
    on: list[str],
    same: list[str] | None = None,
) -> DataFrame:
    """Score index rows against the query rows that share the keys ``on``, the ``k`` best of each key.

    Both sides of a key must be bounded; callers add block numbers for that.
    ``same`` are those of ``by`` that tell queries apart, all by default.
    """
    same = by if same is None else same

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = unit_matrix(right.column("embedding"), dim)
        alive = np.flatnonzero(~np.isnan(rows[:, 0]))
        names = right.select(by).combine_chunks().take(pa.array(alive))
        found = score_table(left.combine_chunks(), rows[alive], names, k, scope, keep)
        parts = list(found if k is None else keep_best(found, k, [*scope, *same], PENDING))
        return pa.Table.from_batches(parts) if parts else empty

    schema = out_schema(index, queries, scope, by, keep)
    empty = to_arrow_schema(schema).empty_table()
    return index.groupBy(*on).cogroup(queries.groupBy(*on)).applyInArrow(task, schema)


def nearest_blocked(
    index: DataFrame,
    queries: DataFrame,
    k: int | None,
    dim: int,
    scope: list[str],
    by: list[str],
    keep: list[str],
    block_rows: int | None = None,
) -> DataFrame:
    """Exact search without a broadcast.

    Both sides are cut into even blocks by a hash of their identity, which no
    hot repository can unbalance, and every pair of blocks becomes one bounded
    task. Each side is copied once per block of the other side. Blocks have
    ``block_rows`` rows, or as many as it takes to have ``SIDE_BLOCKS`` of them,
    but never more than ``BLOCK_CELLS`` components; so the copies of a row do
    not grow with the tables until blocks are full. With ``k=None`` they are not
    enlarged, because all pairs of a task are in its result.
    """
    most = max(1, BLOCK_CELLS // dim)
    files = _columns(index, scope, keep)
    asks = queries.where(F.col("embedding").isNotNull()).select(*by, "embedding")

    def blocks(n: int) -> int:
        if k is None:
            return max(1, -(-n // (block_rows or FULL_BLOCK_ROWS)))
        rows = max(block_rows or most, min(most, -(-n // SIDE_BLOCKS)))
        return max(1, -(-n // rows))

    file_blocks, ask_blocks = blocks(files.count()), blocks(asks.count())

    def block(n: int, *columns: str):
        return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = files.withColumn("_fb", block(file_blocks, *scope, "idx")).withColumn("_qb", every(ask_blocks))
    right = asks.withColumn("_qb", block(ask_blocks, *by)).withColumn("_fb", every(file_blocks))
    found = nearest_grouped(left, right, k, dim, scope, by, keep, ["_fb", "_qb"])
    return _top(found, k, scope, by)


def nearest(
    index: DataFrame,
    queries: DataFrame,
    k: int | None,
    dim: int,
    scope: list[str] | None = None,
    by: list[str] | None = None,
    keep: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` nearest files of every query, per scope.

    ``index`` holds ``idx``, ``embedding``, the scope columns and the columns
    to ``keep``; ``queries`` holds the columns ``by`` and ``embedding``. Gives
    ``cos_sim``, ``distance`` and the rank ``rk``. ``k=None`` returns every
    file for every query, without a rank (see ``rank_all``).

    The query matrix goes to every task in parts of ``broadcast_bytes`` (see
    ``query_parts``); at any number of queries the index is scanned, not moved.
    """
    scope = ["repo_id"] if scope is None else scope
    by = ["section_name"] if by is None else by
    keep = ["path"] if keep is None else keep
    schema = out_schema(index, queries, scope, by, keep)

    def search(files: DataFrame, matrix: pa.Table) -> DataFrame:
        return files.mapInArrow(best_task(index.sparkSession, matrix, k, dim, scope, by, keep), schema)

    return query_parts(_columns(index, scope, keep), queries, k, dim, scope, by, search, broadcast_bytes)


def score_both(
    index: DataFrame, queries: DataFrame, dims: tuple[int, int], scope: list[str], by: list[str], keep: list[str], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Every file against every query with two models at once: ``scope, keep, by, cos_1, cos_2``.

    ``index`` holds ``embedding_1`` and ``embedding_2``, and so does
    ``queries``, where one of them may be NULL; its cosines are NULL then. One
    pass gives one row per pair where two rankings give two. Queries beyond
    ``broadcast_bytes`` are worked off in parts.
    """
    fields = [index.schema[c] for c in [*scope, *keep]] + [queries.schema[c] for c in by]
    schema = T.StructType([*fields, T.StructField("cos_1", T.DoubleType()), T.StructField("cos_2", T.DoubleType())])
    files = index.select(*scope, *keep, "embedding_1", "embedding_2")

    def search(matrix: pa.Table) -> DataFrame:
        vectors = [_filled(matrix.column(f"embedding_{i}"), dim) for i, dim in enumerate(dims, 1)]
        shared = files.sparkSession.sparkContext.broadcast((vectors, matrix.select(by).combine_chunks()))

        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asks, names = shared.value
            step = max(1, min(CELLS // max(1, names.num_rows), BLOCK_CELLS // max(dims)))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    piece = batch.slice(start, step)
                    sims = [np.rint(q @ unit_matrix(piece.column(f"embedding_{i}"), dim).T * UNIT) / UNIT for i, (q, dim) in enumerate(zip(asks, dims), 1)]
                    file = pa.array(np.tile(np.arange(piece.num_rows), names.num_rows))
                    query = pa.array(np.repeat(np.arange(names.num_rows), piece.num_rows))
                    columns = [piece.column(c).take(file) for c in [*scope, *keep]]
                    columns += [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in names.take(query).columns]
                    columns += [pa.array(s.ravel(), mask=np.isnan(s.ravel())) for s in sims]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return files.mapInArrow(task, schema)

    limit = max(1, broadcast_bytes // (8 * sum(dims)))
    asks = stored(queries.select(*by, "embedding_1", "embedding_2"), "queries")
    parts = max(1, -(-asks.count() * 10 // (9 * limit)))
    part = F.pmod(F.xxhash64(*by), F.lit(parts))
    return reduce(DataFrame.unionByName, [search(asks.where(part == i).toArrow()) for i in range(parts)])


def _filled(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit vectors; NaN where the list is NULL."""
    column = column.combine_chunks()
    out = np.full((len(column), dim), np.nan)
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(there):
        out[there] = unit_matrix(column.take(pa.array(there)), dim)
    return out


def rank_all(hits: DataFrame, scope: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Add ``rk`` to complete rankings, whatever the size of a repository.

    The hits are written first: sorting by range reads its input twice, and
    scoring once and reading twice is cheaper than scoring twice.
    """
    scope = ["repo_id"] if scope is None else scope
    by = ["section_name"] if by is None else by
    return number_rows(stored(hits, "hits"), [*scope, *by], ["distance", "idx"], "rk")
