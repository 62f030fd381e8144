"""Domain tables derived from the given ones; ``oracle`` states the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceline.operators.embed import HashModel, LoadedModel
from traceline.sources.readers import read_table

MODEL_A = HashModel("hash_a", 64)
MODEL_B = HashModel("hash_b", 32, first_digit=8)
# Fails on texts with an address, whatever their length.
MODEL_PICKY = HashModel("hash_picky", 64, refuse="@")



def _load_letters():
    """Length and two letter counts, in thousands."""
    return lambda texts: [[len(t) / 1000, t.count("e") / 1000, t.count("\n") / 1000] for t in texts]


MODEL_LETTERS = LoadedModel("letters", 3, _load_letters, batch=50)

VECTOR_DIMS = {"vec_a": 64, "vec_b": 128}


# Tables of long texts, with the key their rows are dealt out by.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return read_table(spark, path, TEXTS[name]) if name in TEXTS else spark.read.parquet(path)


def files(spark: SparkSession, sf: str) -> DataFrame:
    """``repo_id, pos, path, content`` of documents and web pages.

    The suffix follows the language, so German and Spanish texts are no source
    files; the upper-case one tests that the suffix is case-sensitive.
    """
    suffix = F.when(F.col("lang") == "en", ".php").when(F.col("lang") == "fr", ".py").when(F.col("lang") == "de", ".txt").otherwise(".PHP")
    documents = table(spark, sf, "documents").select(
        F.col("source").alias("repo_id"),
        F.col("doc_id").alias("pos"),
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.col("text").alias("content"),
    )
    pages = table(spark, sf, "pages").select(
        F.lit("web").alias("repo_id"),
        F.col("page_id").alias("pos"),
        F.concat(F.lit("web/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("content"),
    )
    return documents.unionByName(pages)


def requirements(spark: SparkSession, sf: str) -> DataFrame:
    """``row_idx, section_name, req_description``: every document is a requirement.

    Toxic ones count as deleted, French ones carry a remark in parentheses.
    """
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    mark = F.when(F.col("toxic") == 1, "[DELETED, toxic] ").otherwise("")
    remark = F.when(F.col("lang") == "fr", F.concat(F.lit(" (C"), F.col("doc_id").cast("string"), F.lit(")"))).otherwise("")
    return (
        table(spark, sf, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("row_idx"),
            F.col("source").alias("section_name"),
            F.concat(mark, "text", remark).alias("req_description"),
        )
    )


def query_texts(spark: SparkSession, sf: str) -> DataFrame:
    """``query_id, query`` of benchmark items and user turns."""
    items = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query")
    )
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    turns = turns.select(
        F.concat(F.lit("turn_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("query"),
    )
    return items.unionByName(turns)


def _vector(model: str) -> Column:
    """The given vector, or for the second model that vector followed by its squares."""
    given = F.col("embedding").cast("array<double>")
    return given if model == "vec_a" else F.concat(given, F.transform(given, lambda x: x * x))


def vectors(spark: SparkSession, sf: str, model: str = "vec_a") -> DataFrame:
    """``repo_id, model, idx, path, embedding``; base names repeat by label."""
    return table(spark, sf, "embeddings").select(
        F.lit("vectors").alias("repo_id"),
        F.lit(model).alias("model"),
        F.col("vec_id").alias("idx"),
        F.concat(F.lit("v/"), F.col("vec_id").cast("string"), F.lit("/f"), F.col("label").cast("string"), F.lit(".php")).alias("path"),
        _vector(model).alias("embedding"),
    )


def vector_queries(spark: SparkSession, sf: str, model: str = "vec_a") -> DataFrame:
    """Every vector as a query; its own file is at distance 0."""
    return vectors(spark, sf, model).select(F.col("idx").alias("q"), "embedding")


def vector_sections(spark: SparkSession, sf: str, model: str = "vec_a") -> DataFrame:
    """One section per label, asking with the mean of all vectors of the label."""
    parts = table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode(_vector(model)).alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg("x").alias("mean"), F.min("vec_id").alias("first_row"))
    return (
        means.groupBy("label")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda p: p["mean"]).alias("embedding"),
            F.min("first_row").alias("first_row"),
        )
        .select(F.concat(F.lit("f"), F.col("label").cast("string")).alias("section_name"), "first_row", "embedding")
    )
