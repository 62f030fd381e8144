"""Writers of results, files, payloads and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceline.functions.codec import encode_blob
from traceline.operators.nest import FILES_PER_BLOCK, result_lines, tree_documents


def write_result_json(results: DataFrame, path: str, depth: int | None = None, by: str = "repo_id") -> None:
    """Results as JSON lines under ``repo_id=`` (and ``depth=``) folders.

    A line holds a section, or a fixed run of the files of a long one, with its
    place; the layout does not depend on the size of a result.
    """
    documents = result_lines(results).select("repo_id", F.lit(depth).alias("depth"), "first_row", "section_name", "piece", "line")
    folders = ["repo_id"] if depth is None else ["depth", "repo_id"]
    if by != "repo_id":
        documents = documents.withColumnRenamed("repo_id", by)
        folders = [by if f == "repo_id" else f for f in folders]
    (
        documents.hint("rebalance", *folders)
        .sortWithinPartitions(*folders, "first_row", "section_name", "piece")
        .select(*folders, F.col("line").alias("value"))
        .write.partitionBy(*folders)
        .text(path)
    )


def write_results(results: DataFrame, path: str) -> None:
    """The long table as Parquet, one folder per repository."""
    results.hint("rebalance", "repo_id").write.partitionBy("repo_id").parquet(path)


def write_files(files: DataFrame, path: str) -> None:
    """Decoded files as Parquet, one folder per repository."""
    files.hint("rebalance", "repo_id").write.partitionBy("repo_id").parquet(path)


def encode_files(files: DataFrame) -> DataFrame:
    return files.withColumn("content", encode_blob(F.col("content")))


def payloads(tree: DataFrame, per_payload: int = FILES_PER_BLOCK) -> DataFrame:
    """Encoded files as ``id, repository_tree, part, parts`` of at most ``per_payload``."""
    part = F.floor(F.col("pos") / per_payload).alias("part")
    counted = tree.groupBy(F.col("repo_id").alias("id")).agg(F.count_distinct(part).alias("parts"))
    blob = F.struct(F.lit("blob").alias("type"), F.lit("base64").alias("encode"), "content")
    entries = F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("path").alias("key"), blob.alias("value")).alias("e"))))
    return (
        tree.groupBy(F.col("repo_id").alias("id"), part)
        .agg(F.map_from_entries(F.transform(entries, lambda x: x["e"])).alias("repository_tree"))
        .join(counted, "id")
        .select("id", "repository_tree", "part", "parts")
    )


def write_payloads(files: DataFrame, path: str, per_payload: int = FILES_PER_BLOCK) -> None:
    """One payload object per line."""
    write_encoded_payloads(encode_files(files), path, per_payload)


def write_encoded_payloads(tree: DataFrame, path: str, per_payload: int = FILES_PER_BLOCK) -> None:
    payloads(tree, per_payload).write.json(path)


def write_repo_tree(files: DataFrame, path: str, per_object: int = FILES_PER_BLOCK) -> None:
    """Name-to-blob objects as text under ``repo_id=`` and ``part=`` folders."""
    (
        tree_documents(encode_files(files), per_object)
        .select("repo_id", F.col("block").alias("part"), F.col("tree").alias("value"))
        .write.partitionBy("repo_id", "part")
        .text(path)
    )


def write_requirements(requirements: DataFrame, path: str) -> None:
    """CSV whose files, in name order, hold the rows in ``row_idx`` order."""
    (
        requirements.repartitionByRange("row_idx")
        .sortWithinPartitions("row_idx")
        .select("section_name", "req_description")
        .write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
