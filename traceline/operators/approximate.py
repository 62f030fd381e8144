"""Approximate neighbours: a stored bucket table, probed as far as a wanted recall asks.

A table hashes a vector to one bit per line, the side of the line on which it
lies; files with equal bits share a bucket. A query looks into its own bucket
and then into those it would be in had it fallen on the other side of the lines
it is nearest to, in the order of its squared distance to them. How many tables
and probes that takes is not guessed: for a sample of queries the exact
neighbours are found, and the cheapest setting that reaches the wanted recall
on them is taken. Where none does, or where it would look at most of the index
anyway, the search is exact.

Buckets hold places, not vectors, and pairs never become rows. Where buckets
are small, candidates are collected as places, and the vectors of a block are
moved once for each group of queries. Where a bucket's places would take more
room than a vector, files and queries meet by bucket instead: a file is moved
once a table and a query once a probe, however many files there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from traceline.functions.scoring import angular_distance
from traceline.operators.knn import BLOCK_CELLS, CELLS, UNIT, nearest, nearest_grouped, still_best, unit_matrix
from traceline.operators.ranking import number_rows
from traceline.runtime import stored

LEAF = 128  # files wanted in a bucket
MAX_TABLES = 32
NEAR_LINES = 10  # probes change sides of these many nearest lines only, so there are at most 1024
RECALL = 0.9
SAMPLE = 256  # queries whose exact neighbours are found to choose a plan
SAMPLE_PAIRS = 20_000  # neighbours of the sample that are looked at
MOST_SHARE = 0.5  # share of the index from which looking at all of it is as good
DENSE = 16  # one pair in so many is enough to multiply all of a block
BLOCK_ROWS = 4096  # files of a block, and queries of a group
PLACE_BYTES, CELL_BYTES = 4, 8  # of a place, of a vector's component
_DECIMALS = 9  # distances to lines are compared as multiples of 1e-9


@dataclass(frozen=True)
class ProbePlan:
    """How far an index is probed; ``recall`` is what the sample measured, None if nothing was."""

    hashes: int
    tables: int
    probes: int
    seed: int = 42
    recall: float | None = None
    exact: bool = False


@dataclass(frozen=True)
class BucketIndex:
    """Files in blocks (``block, place`` beside their own columns) and the bucket table ``table, code, block, places``."""

    files: DataFrame
    buckets: DataFrame
    plan: ProbePlan
    dim: int


def lines(dim: int, count: int, seed: int) -> np.ndarray:
    """``dim x count`` of 1 and -1: the first bit of the MD5 of ``seed:line:component``."""
    signs = [1 if hashlib.md5(f"{seed}:{j}:{d}".encode()).digest()[0] & 128 else -1 for d in range(dim) for j in range(count)]
    return np.array(signs, dtype=np.int8).reshape(dim, count)


def _sides(vectors: np.ndarray, signs: np.ndarray, hashes: int) -> np.ndarray:
    """Signed distances (rows, tables, hashes) of unit vectors to the lines."""
    far = np.round(vectors @ signs.astype(np.float64) / math.sqrt(len(signs)), _DECIMALS)
    return far.reshape(len(vectors), -1, hashes)


def _codes(sides: np.ndarray) -> np.ndarray:
    return ((sides >= 0) * (1 << np.arange(sides.shape[2], dtype=np.int64))).sum(axis=2)


def _flips(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows ``(tables, hashes)`` flattened to ``(rows, hashes)``: what each combination of near lines costs, and its bits.

    Combination 0 changes nothing; the others follow as binary numbers over the
    nearest lines, the nearest first.
    """
    near = min(NEAR_LINES, sides.shape[1])
    order = np.argsort(np.abs(sides), axis=1, kind="stable")[:, :near]
    squares = np.take_along_axis(sides, order, axis=1) ** 2
    chosen = (np.arange(1 << near)[:, None] >> np.arange(near)) & 1
    bits = (np.int64(1) << order.astype(np.int64)) @ chosen.T.astype(np.int64)
    return np.round(squares @ chosen.T.astype(np.float64), _DECIMALS), bits


def probe_codes(sides: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, probes) codes in the order a query looks at them."""
    rows, tables, hashes = sides.shape
    flat = sides.reshape(-1, hashes)
    cost, bits = _flips(flat)
    first = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return (_codes(sides).reshape(-1, 1) ^ np.take_along_axis(bits, first, axis=1)).reshape(rows, tables, -1)


def probe_ranks(asked: np.ndarray, found: np.ndarray) -> np.ndarray:
    """(rows, tables): which probe of the query reaches the bucket of the file; a large number if none does."""
    rows, tables, hashes = asked.shape
    cost, bits = _flips(asked.reshape(-1, hashes))
    order = np.argsort(cost, axis=1, kind="stable")
    wanted = (_codes(asked) ^ _codes(found)).reshape(-1, 1)
    hit = np.take_along_axis(bits, order, axis=1) == wanted
    return np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, 2**30).reshape(rows, tables)


def default_hashes(n_files: int) -> int:
    """Lines of a table whose buckets hold about ``LEAF`` files."""
    return min(40, max(1, round(math.log2(max(1, n_files) / LEAF))))


def solve_plan(ranks: np.ndarray, hashes: int, recall: float, most_share: float, seed: int) -> ProbePlan:
    """The cheapest number of tables and probes whose recall on the sample is at least ``recall``.

    ``ranks`` is ``neighbours x tables``. The cost is the share of the index a
    query looks at, ``tables * probes / 2^hashes`` at even buckets, and at
    equal cost fewer tables are better. Two standard errors of the measured
    share are added to the wanted recall, so that a sample's luck does not count.
    """
    options = []
    least = np.minimum.accumulate(ranks, axis=1)
    probes = 1
    while probes <= 1 << min(NEAR_LINES, hashes):
        reached = (least <= probes).mean(axis=0) if len(ranks) else np.ones(ranks.shape[1])
        sure = reached - 2 * np.sqrt(reached * (1 - reached) / max(1, len(ranks)))
        for t in np.flatnonzero(sure >= recall)[:1]:
            options.append(((t + 1) * probes / 2**hashes, int(t) + 1, probes, float(reached[t])))
        probes *= 2
    if not options or min(options)[0] > most_share:
        return ProbePlan(hashes, 0, 0, seed, 1.0, exact=True)
    _, tables, probes, reached = min(options)
    return ProbePlan(hashes, tables, probes, seed, reached)


def choose_plan(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    scope: list[str],
    by: list[str],
    hashes: int | None = None,
    recall: float = RECALL,
    max_tables: int = MAX_TABLES,
    most_share: float = MOST_SHARE,
    seed: int = 42,
) -> ProbePlan:
    """Measure on ``SAMPLE`` queries how far their exact neighbours are from them in the probing order.

    The sample is the queries with the least hash of their key, and at most
    ``SAMPLE_PAIRS`` of their neighbours by the same rule.
    """
    hashes = hashes or default_hashes(index.where(F.col("embedding").isNotNull()).count())
    usable = queries.where(F.col("embedding").isNotNull()).select(*by, "embedding")
    sample = stored(usable.orderBy(F.xxhash64(*by)).limit(SAMPLE), "sample")
    truth = nearest(index, sample, k, dim, scope, by, []).select(*scope, "idx", *by)
    truth = truth.orderBy(F.xxhash64(*scope, "idx", *by)).limit(SAMPLE_PAIRS)
    vectors = index.select(*scope, "idx", F.col("embedding").alias("_file"))
    # Both joined tables are bounded by the sample; the index is scanned, not moved.
    pairs = vectors.join(F.broadcast(truth), [*scope, "idx"]) if scope else vectors.join(F.broadcast(truth), "idx")
    pairs = pairs.join(F.broadcast(sample), by).select("embedding", "_file")
    signs = lines(dim, max_tables * hashes, seed)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                asked, found = (_sides(unit_matrix(piece.column(c), dim), signs, hashes) for c in ("embedding", "_file"))
                ranks = probe_ranks(asked, found)
                yield pa.RecordBatch.from_arrays([pa.array(ranks.tolist(), pa.list_(pa.int32()))], names=["ranks"])

    found = pairs.mapInArrow(task, "ranks array<int>").toArrow().column("ranks").to_pylist()
    return solve_plan(np.array(found, dtype=np.int64).reshape(len(found), max_tables), hashes, recall, most_share, seed)


def _written(df: DataFrame, path: str | None, name: str) -> DataFrame:
    if path is None:
        return stored(df, name)
    df.write.parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def build_buckets(
    index: DataFrame,
    dim: int,
    plan: ProbePlan,
    scope: list[str],
    keep: list[str],
    block_rows: int = BLOCK_ROWS,
    path: str | None = None,
) -> BucketIndex:
    """Write the files in blocks, those of a bucket of the first table together, and the bucket table.

    With a ``path`` they are kept there together with the plan, for ``read_buckets``.
    A bucket that holds any share of the files, as copies do, is spread over
    blocks and over rows of the bucket table.
    """
    files = index.where(F.col("embedding").isNotNull()).select(*scope, "idx", *keep, "embedding")
    signs = lines(dim, max(1, plan.tables) * plan.hashes, plan.seed)
    hashes = plan.hashes

    def first_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unit_matrix(batch.column("embedding"), dim)
            code = _codes(_sides(np.nan_to_num(vectors), signs[:, :hashes], hashes))[:, 0]
            alive = pa.array(~np.isnan(vectors[:, 0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "_code"]).filter(alive)

    schema = T.StructType([*files.schema, T.StructField("_code", T.LongType())])
    coded = stored(files.mapInArrow(first_code, schema), "coded")
    seated = number_rows(coded, [], ["_code", *scope, "idx"], "_seat", start=0)
    laid = _written(
        seated.select(
            *files.columns,
            F.floor(F.col("_seat") / block_rows).alias("block"),
            (F.col("_seat") % block_rows).cast("int").alias("place"),
        ),
        path,
        "files",
    )

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _codes(_sides(unit_matrix(batch.column("embedding"), dim), signs, hashes))
            rows, tables = found.shape
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), rows)),
                    pa.array(found.ravel()),
                    pa.array(np.repeat(batch.column("block").to_numpy(), tables)),
                    pa.array(np.repeat(batch.column("place").to_numpy(), tables)),
                ],
                names=["table", "code", "block", "place"],
            )

    hashed = laid.select("embedding", "block", "place").mapInArrow(codes, "table int, code long, block long, place int")
    # A block bounds what comes together in one row.
    buckets = _written(hashed.groupBy("table", "code", "block").agg(F.collect_list("place").alias("places")), path, "buckets")
    if path is not None:
        rows = [(*asdict(plan).values(), dim)]
        index.sparkSession.createDataFrame(rows, _PLAN).coalesce(1).write.parquet(f"{path}/plan")
    return BucketIndex(laid, buckets, plan, dim)


_PLAN = "hashes int, tables int, probes int, seed long, recall double, exact boolean, dim int"


def read_buckets(spark: SparkSession, path: str) -> BucketIndex:
    *plan, dim = spark.read.schema(_PLAN).parquet(f"{path}/plan").first()
    return BucketIndex(spark.read.parquet(f"{path}/files"), spark.read.parquet(f"{path}/buckets"), ProbePlan(*plan), dim)


def _products(left: np.ndarray, right: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Inner products of the pairs ``row * len(right) + column`` in rising ``cells``.

    Many pairs are taken from whole products, which cost less than as many
    pairs of gathered rows.
    """
    out = np.empty(len(cells))
    if len(cells) * DENSE > len(left) * len(right):
        step = max(1, CELLS // len(right))
        for a in range(0, len(left), step):
            first, last = np.searchsorted(cells, [a * len(right), (a + step) * len(right)])
            out[first:last] = (left[a : a + step] @ right.T).ravel()[cells[first:last] - a * len(right)]
        return out
    step = max(1, BLOCK_CELLS // max(1, left.shape[1]))
    for i in range(0, len(cells), step):
        row, column = cells[i : i + step] // len(right), cells[i : i + step] % len(right)
        out[i : i + step] = np.einsum("ij,ij->i", left[row], right[column])
    return out


def search_buckets(
    index: BucketIndex, queries: DataFrame, k: int, scope: list[str], by: list[str], keep: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``k`` best candidates of every query and scope, exactly scored, without filling up short answers."""
    plan, dim = index.plan, index.dim
    if plan.exact:
        return nearest(index.files, queries, k, dim, scope, by, keep)
    if index.files.count() * PLACE_BYTES > 2**plan.hashes * dim * CELL_BYTES:
        return _search_by_bucket(index, queries, k, scope, by, keep)
    usable = queries.where(F.col("embedding").isNotNull()).select(*by, "embedding")
    asks = stored(usable.withColumn("_q", F.monotonically_increasing_id()), "asks")
    signs = lines(dim, plan.tables * plan.hashes, plan.seed)
    hashes, probes = plan.hashes, plan.probes

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                vectors = unit_matrix(piece.column("embedding"), dim)
                alive = np.flatnonzero(~np.isnan(vectors[:, 0]))
                codes = probe_codes(_sides(vectors[alive], signs, hashes), probes)
                rows, tables, each = codes.shape
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(piece.column("_q").to_numpy()[alive], tables * each)),
                        pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), rows)),
                        pa.array(codes.ravel()),
                    ],
                    names=["_q", "table", "code"],
                )

    probed = asks.select("_q", "embedding").mapInArrow(probe, "_q long, table int, code long")
    met = probed.join(index.buckets, ["table", "code"]).groupBy("block", "_q").agg(F.flatten(F.collect_list("places")).alias("_places"))
    groups = max(1, -(-asks.count() // block_rows))
    group = F.pmod(F.xxhash64("_q"), F.lit(groups)).alias("_group")
    wanted = stored(met.select("block", group, "_q", "_places"), "candidates")
    asked = wanted.join(asks, "_q")
    pairs = stored(wanted.select("block", "_group").distinct(), "touched")
    files = index.files.select(*scope, "idx", *keep, "embedding", "block", "place").join(pairs, "block")
    # Whatever the columns are called, they meet by place.
    names = [f"c{i}" for i in range(len(scope) + 1 + len(keep))]
    own = [f"q{i}" for i in range(len(by))]
    left = files.select("block", "_group", F.struct(*[F.col(c).alias(n) for c, n in zip([*scope, "idx", *keep], names)]).alias("_row"), "embedding", "place")
    right = asked.select("block", "_group", F.struct(*[F.col(c).alias(n) for c, n in zip(by, own)]).alias("_ask"), "_q", "embedding", "_places")
    inner = T.StructType([left.schema["_row"], right.schema["_ask"], T.StructField("_q", T.LongType()), T.StructField("cos_sim", T.DoubleType())])
    empty = to_arrow_schema(inner).empty_table()
    n_scope = len(scope)

    def task(given: pa.Table, asked: pa.Table) -> pa.Table:
        if not given.num_rows or not asked.num_rows:
            return empty
        vectors, asking = (unit_matrix(t.column("embedding"), dim) for t in (given, asked))
        seat = np.full(int(max(given.column("place").to_numpy().max(), 0)) + 1, -1, dtype=np.int64)
        seat[given.column("place").to_numpy()] = np.arange(given.num_rows)
        places = asked.column("_places").combine_chunks()
        query = np.repeat(np.arange(asked.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
        # A file may be in a probed bucket of several tables.
        cells = np.unique(query * given.num_rows + seat[places.flatten().to_numpy(zero_copy_only=False)])
        query, file = cells // given.num_rows, cells % given.num_rows
        sims = np.rint(_products(asking, vectors, cells) * UNIT) / UNIT
        rows = given.column("_row").combine_chunks()
        marks = [rows.field(i).take(pa.array(file)) for i in range(n_scope)]
        scored = pa.table(
            [*marks, pa.array(query), rows.field(n_scope).take(pa.array(file)), pa.array(file), pa.array(sims)],
            names=[*[f"s{i}" for i in range(n_scope)], "query", "idx", "file", "cos_sim"],
        )
        best = still_best(scored, k, [*[f"s{i}" for i in range(n_scope)], "query"])
        query, file = best.column("query").combine_chunks(), best.column("file").combine_chunks()
        parts = [rows.take(file), asked.column("_ask").combine_chunks().take(query), asked.column("_q").combine_chunks().take(query)]
        return pa.table([*parts, best.column("cos_sim").combine_chunks()], schema=empty.schema)

    on = ["block", "_group"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(task, inner)
    columns = [F.col("_row")[n].alias(c) for c, n in zip([*scope, "idx", *keep], names)]
    flat = found.select(*columns, *[F.col("_ask")[n].alias(c) for c, n in zip(by, own)], "cos_sim")
    order = Window.partitionBy(*scope, *by).orderBy(F.col("cos_sim").desc(), "idx")
    ranked = flat.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
    return ranked.withColumn("distance", angular_distance(F.col("cos_sim")))


def _search_by_bucket(
    index: BucketIndex, queries: DataFrame, k: int, scope: list[str], by: list[str], keep: list[str], bucket_rows: int | None = None
) -> DataFrame:
    """As ``search_buckets``, for buckets that hold many files: each bucket is searched exactly by the queries that probe it.

    A bucket of more than ``bucket_rows`` files or queries is dealt to several
    tasks, and the copies of the other side grow with that only.
    """
    plan, dim = index.plan, index.dim
    hashes, probes = plan.hashes, plan.probes
    signs = lines(dim, plan.tables * hashes, plan.seed)
    rows = bucket_rows or max(1, BLOCK_CELLS // dim)
    usable = queries.where(F.col("embedding").isNotNull()).select(*by, "embedding")
    asks = stored(usable.withColumn("_q", F.monotonically_increasing_id()), "asks")
    # Whatever the columns are called, they do not clash with those added here.
    own = [f"c{i}" for i in range(len(scope) + len(keep))]
    asked = [f"q{i}" for i in range(len(by))]

    def coded(df: DataFrame, codes) -> DataFrame:
        """``codes`` of every vector as ``_codes``: for each table the buckets it is in or looks into."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    piece = batch.slice(start, 64)
                    vectors = unit_matrix(piece.column("embedding"), dim)
                    alive = np.flatnonzero(~np.isnan(vectors[:, 0]))
                    found = codes(_sides(vectors[alive], signs, hashes))
                    kept = piece.take(pa.array(alive))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found.tolist(), _CODES)], names=[*kept.schema.names, "_codes"])

        schema = T.StructType([*df.schema, T.StructField("_codes", T.ArrayType(T.ArrayType(T.LongType())))])
        out = df.mapInArrow(task, schema).select("*", F.posexplode("_codes").alias("_table", "_each"))
        return out.select(*df.columns, "_table", F.explode("_each").alias("_code"))

    left = index.files.select(
        *[F.col(c).alias(n) for c, n in zip([*scope, *keep], own)], "idx", "embedding", "block", "place"
    )
    right = asks.select(*[F.col(c).alias(n) for c, n in zip(by, asked)], "_q", "embedding")
    left, right = coded(left, lambda s: _codes(s)[:, :, None]), coded(right, lambda s: probe_codes(s, probes))

    def tiles(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy("_table", "_code").agg(F.count("*").alias("_n"))
        return counts.select("_table", "_code", F.ceil(F.col("_n") / rows).cast("int").alias(name))

    # Two numbers a bucket.
    sizes = stored(tiles(left, "_lt").join(tiles(right, "_rt"), ["_table", "_code"]), "buckets")

    def dealt(df: DataFrame, mine: str, other: str, *key: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at")
        tile = F.pmod(F.xxhash64(*key), F.col(mine)).cast("int").alias(f"{mine}_at")
        columns = [c for c in df.columns if c not in ("_table", "_code")]
        return df.join(sizes, ["_table", "_code"]).select(*columns, "_table", "_code", tile, every)

    on = ["_table", "_code", "_lt_at", "_rt_at"]
    scopes, kept = own[: len(scope)], own[len(scope) :]
    found = nearest_grouped(
        dealt(left, "_lt", "_rt", "block", "place"), dealt(right, "_rt", "_lt", "_q"),
        k, dim, scopes, ["_q", *asked], [*kept, "block", "place"], on, same=["_q"],
    )
    # A file may be in a probed bucket of several tables.
    single = found.repartition(*asked).dropDuplicates([*asked, "_q", "block", "place"])
    order = Window.partitionBy(*scopes, *asked).orderBy(F.col("cos_sim").desc(), "idx")
    ranked = single.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
    names = [F.col(n).alias(c) for c, n in zip(scope, scopes)] + ["idx"] + [F.col(n).alias(c) for c, n in zip(keep, kept)]
    flat = ranked.select(*names, *[F.col(n).alias(c) for c, n in zip(by, asked)], "cos_sim", "rk")
    return flat.withColumn("distance", angular_distance(F.col("cos_sim")))


_CODES = pa.list_(pa.list_(pa.int64()))


def nearest_lsh(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    scope: list[str] | None = None,
    by: list[str] | None = None,
    keep: list[str] | None = None,
    plan: ProbePlan | None = None,
    recall: float = RECALL,
    hashes: int | None = None,
    most_share: float = MOST_SHARE,
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
    complete: bool = True,
) -> DataFrame:
    """The ``k`` nearest files of every query and scope, of which at least ``recall`` are found.

    Without a ``plan`` one is measured (``choose_plan``), for the given number
    of ``hashes`` or one that follows from the size of the index; it may say
    that the exact search is the better way. Queries for which a scope gave
    fewer than ``k`` files are searched exactly when ``complete``. ``by`` must
    tell queries apart. Both inputs are read several times and should be
    written tables. For many searches of one index see ``build_buckets``.
    """
    scope = ["repo_id"] if scope is None else scope
    by = ["section_name"] if by is None else by
    keep = ["path"] if keep is None else keep
    plan = plan or choose_plan(index, queries, k, dim, scope, by, hashes, recall, most_share=most_share, seed=seed)
    if plan.exact:
        return nearest(index, queries, k, dim, scope, by, keep)
    ranked = search_buckets(build_buckets(index, dim, plan, scope, keep, block_rows), queries, k, scope, by, keep, block_rows)
    if not complete:
        return ranked
    files = index.where(F.col("embedding").isNotNull()).select(*scope, "idx", *keep, "embedding")
    asks = queries.where(F.col("embedding").isNotNull()).select(*by, "embedding")
    return _completed(stored(ranked, "ranked"), files, asks, k, dim, scope, by, keep)


def _completed(
    ranked: DataFrame,
    files: DataFrame,
    asks: DataFrame,
    k: int,
    dim: int,
    scope: list[str],
    by: list[str],
    keep: list[str],
) -> DataFrame:
    """Replace the answers of queries that came out short in some scope."""
    found = ranked.groupBy(*scope, *by).agg(F.count("*").alias("_n"))
    if scope:
        sizes = files.groupBy(*scope).agg(F.least(F.count("*"), F.lit(k)).alias("_need"))
        scopes = sizes.count()
        found = found.join(sizes, scope)
    else:
        scopes = 1
        found = found.withColumn("_need", F.lit(min(k, files.count())))
    enough = found.where(F.col("_n") >= F.col("_need")).groupBy(*by).agg(F.count("*").alias("_done"))
    full = enough.where(F.col("_done") == scopes).select(*by)
    full = stored(full, "answered")
    exact = nearest(files, asks.join(full, by, "left_anti"), k, dim, scope, by, keep)
    return ranked.join(full, by, "left_semi").unionByName(exact.select(*ranked.columns))
