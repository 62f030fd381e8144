"""The vector index: one table of vectors and names, by repository and model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from traceline.operators.embed import Model, count_columns, embed, embedded_ok
from traceline.operators.ranking import number_files
from traceline.runtime import stored

INDEX_COLUMNS = ["repo_id", "model", "idx", "path", "embedding", "dim"]


def build_index(files: DataFrame, model: Model, counts: Observation | None = None) -> DataFrame:
    """Embed files and number those that worked, densely from 0 in input order.

    ``counts`` is told ``files_found``, ``files_indexed`` and ``files_failed``
    by the pass that embeds.

    The vectors are written before they are numbered, because sorting by range
    reads its input twice and embedding is the costly part.
    """
    embedded = embed(files, "content", model)
    if counts is not None:
        embedded = embedded.observe(counts, *count_columns())
    vectors = embedded_ok(embedded).select("repo_id", "model", "pos", "path", "embedding", "dim")
    return number_files(stored(vectors, "vectors")).select(*INDEX_COLUMNS)


def write_index(index: DataFrame, path: str) -> None:
    """Replace the partitions present in ``index``; others stay.

    The rebalance hint gives each partition directory as few files as its size
    allows and splits the directory of a very large repository.
    """
    (
        index.hint("rebalance", "repo_id", "model")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo_id", "model")
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str, repo_id: str | None = None, model: Model | None = None) -> DataFrame:
    """Read with partition pruning; a model of another dimension raises.

    Partition values stay strings, so a numeric repository id does not change.
    """
    schema = "idx long, path string, embedding array<float>, dim int, repo_id string, model string"
    index = spark.read.schema(schema).parquet(path)
    if repo_id is not None:
        index = index.where(F.col("repo_id") == repo_id)
    if model is not None:
        index = index.where(F.col("model") == model.name).withColumn(
            "embedding",
            F.when(F.col("dim") == model.dim, F.col("embedding")).otherwise(
                F.raise_error(F.lit(f"dimension mismatch: the model gives vectors of {model.dim}"))
            ),
        )
    return index.select(*INDEX_COLUMNS)


def index_map(index: DataFrame) -> DataFrame:
    return index.select("repo_id", "model", "idx", "path")


def total_files(index: DataFrame) -> DataFrame:
    return index.groupBy("repo_id", "model").agg(F.count("*").alias("total_files"))


def build_or_load(
    files: DataFrame, stored_vectors: DataFrame | None, model: Model, mode: str = "refresh"
) -> DataFrame:
    """Vectors of ``files``, embedding only what the store does not hold.

    ``stored_vectors`` has ``repo_id, path, digest, embedding``. Mode
    ``refresh`` re-embeds new and changed contents; ``exists`` takes the store
    as it is whenever there is one.
    """
    columns = ["repo_id", "path", "digest", "embedding"]
    if mode not in ("refresh", "exists"):
        raise ValueError(f"unknown mode {mode!r}")
    wanted = files.withColumn("digest", F.sha2("content", 256))
    if stored_vectors is None:
        return embedded_ok(embed(wanted, "content", model)).select(*columns)
    if mode == "exists":
        return stored_vectors.select(*columns)
    on = ["repo_id", "path", "digest"]
    reused = stored_vectors.join(wanted.select(*on), on, "left_semi").select(*columns)
    missing = wanted.join(stored_vectors.select(*on), on, "left_anti")
    return reused.unionByName(embedded_ok(embed(missing, "content", model)).select(*columns))
