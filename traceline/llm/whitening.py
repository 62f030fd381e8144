"""Whitened principal components of vectors, by distributed block matrices.

Rows are numbered, centred and laid out as an MLlib ``BlockMatrix``. Its
transpose times itself is the scatter matrix; the product is split along the
rows, so each task multiplies a few blocks and only matrices of ``dim x dim``
are added up. The eigenvectors of that one small matrix are found on the
driver; a second block product projects the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.runtime import stored

COMPONENTS = 4
SCALE = 256
MAX_DIM = 4096  # the scatter matrix of this side (128 MB) is the most the driver takes
BLOCK_CELLS = 2**18  # components of one block
BLOCKS_PER_TASK = 16  # row blocks whose products are added up in one task
_ROW_BITS = 33  # monotonically_increasing_id puts the partition above bit 33
# An eigenvalue below this share of the greatest is a zero up to rounding.
_ZERO = 1e-12


def finite(vector: str) -> Column:
    """True for vectors without NULL, NaN or infinite components."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def scaled(df: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """``key, x``: whole multiples ``floor(scale * c)`` of the finite vectors."""
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    return df.where(finite(vector)).select(F.col(key).alias("key"), whole.alias("x"))


def number_densely(df: DataFrame, into: str) -> DataFrame:
    """Rows numbered from 0 without gaps, in no particular order, as a written table.

    The numbers of the writing tasks are kept, so nothing is sorted and the
    counts of the tasks are all that is gathered.
    """
    laid = stored(df.withColumn("_seat", F.monotonically_increasing_id()), "rows")
    pid = F.shiftright("_seat", _ROW_BITS)
    counts = sorted(map(tuple, laid.groupBy(pid.alias("p")).agg(F.count("*"), F.min("_seat")).collect()))
    shifts, before = [], 0
    for p, n, least in counts:
        shifts.append((p, before - least))
        before += n
    shift = df.sparkSession.createDataFrame(shifts, "_pid long, _shift long")
    return laid.withColumn("_pid", pid).join(F.broadcast(shift), "_pid").select(*df.columns, (F.col("_seat") + F.col("_shift")).alias(into))


def _block_matrix(rows: DataFrame, dim: int, n_rows: int) -> BlockMatrix:
    """Blocks of ``at, centred``; rows that are missing are zero."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("at", array_to_vector("centred").alias("v")), "v")
    matrix = IndexedRowMatrix(vectors, n_rows, dim)
    return matrix.toBlockMatrix(max(1, BLOCK_CELLS // dim), dim)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int, rows: int, cols: int) -> BlockMatrix:
    """``left x right`` with the inner dimension dealt to ``splits`` tasks.

    The method of MLlib has this argument, its Python form does not pass it on.
    Without it a result of one block is made by one task.
    """
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, rows, cols)


def _scatter(rows: DataFrame, dim: int, n_rows: int) -> np.ndarray:
    matrix = _block_matrix(rows, dim, n_rows)
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_PER_TASK))
    return _product(matrix.transpose(), matrix, splits, dim, dim).toLocalMatrix().toArray()


def _project(rows: DataFrame, weights: np.ndarray, n_rows: int) -> DataFrame:
    """``at, w``: rows times ``weights`` (``dim x components``)."""
    dim, width = weights.shape
    local = Matrices.dense(dim, width, weights.ravel(order="F"))
    small = BlockMatrix(rows.sparkSession.sparkContext.parallelize([((0, 0), local)], 1), dim, width)
    product = _block_matrix(rows, dim, n_rows).multiply(small).toIndexedRowMatrix()
    found = product.rows.map(lambda r: (int(r.index), [float(v) for v in r.vector.toArray()]))
    return rows.sparkSession.createDataFrame(found, "at long, w array<double>")


def eigen(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues above zero, falling, and their unit vectors as columns."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(initial=0), 0) * _ZERO]
    return values[order], vectors[:, order]


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every row with a finite vector.

    Components become ``floor(scale * c)``. The fit list holds each distinct
    vector once: ``n`` of them with sums ``S``. ``deviation`` is the exact sum
    of ``(n x - S)^2``, NULL where that is no long. Rows whose vector is NULL or
    holds NULL or non-finite entries are left out; a NULL or repeated key is
    kept, one row each. A vector that is shorter than the longest counts as
    ending in zeros. Components whose eigenvalue is zero (fewer distinct vectors
    or dimensions than components) are left out, so a table of equal rows, like
    an empty one, gives none. ``dim`` may be at most ``MAX_DIM``.
    """
    rows = number_densely(scaled(df, scale, key, vector), "at")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    count, dim = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not dim:
        return df.sparkSession.createDataFrame([], schema)
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} components; the scatter matrix is limited to {MAX_DIM}")
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))
    rows = rows.withColumn("x", F.concat("x", zeros))

    # Equal vectors are reduced in their own tasks before they meet; the least number stands for all.
    fit = stored(rows.groupBy("x").agg(F.min("at").alias("at")), "distinct")
    sums = dict(map(tuple, fit.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum("c")).collect()))
    n, total = fit.count(), [sums[d] for d in range(dim)]
    mean = F.array(*[F.lit(s / n) for s in total])
    off = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in total]), lambda c, s: F.try_subtract(F.try_multiply(c, F.lit(n).cast("long")), s))
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda acc, d: F.try_add(acc, F.try_multiply(d, d)))

    def centred(table: DataFrame) -> DataFrame:
        return table.select("at", F.zip_with("x", mean, lambda c, m: c - m).alias("centred"))

    covariance = _scatter(centred(fit), dim, count) / n
    values, vectors = eigen(covariance, components)
    if not len(values):
        return df.sparkSession.createDataFrame([], schema)
    projected = _project(centred(rows), vectors / np.sqrt(values), count)
    told = fit.select("at", F.lit(True).alias("fitted"))
    named = rows.select("at", "key", deviation.alias("deviation")).join(projected, "at").join(told, "at", "left")
    found = stored(named.select("key", "deviation", "w", F.coalesce("fitted", F.lit(False)).alias("fitted")), "projected")

    error = _identity_error(found.where("fitted"), len(values), n)
    explained = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)])
    return found.select("key", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        F.col("key").alias(key),
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("i") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _identity_error(fitted: DataFrame, width: int, n: int) -> float:
    """Greatest absolute entry of the covariance of ``w`` minus the identity."""
    w = [F.col("w")[i] for i in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    means = [m or 0.0 for m in fitted.agg(*[F.avg(c) for c in w]).first()]
    entries = fitted.agg(*[F.sum((w[i] - means[i]) * (w[j] - means[j])) / n for i, j in pairs]).first()
    return max(abs(entry - (i == j)) for (i, j), entry in zip(pairs, entries))
