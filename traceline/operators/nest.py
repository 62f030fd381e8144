"""Section results as nested rows and JSON text.

A result table is long: ``repo_id, section_name, first_row, kind, pos,
file_name, score`` with one row per file; a section without files has one row
whose ``pos`` is NULL. Nested forms are built in bounded pieces. Results of
ordinary size come out as one piece, larger ones as several, each a valid
object of the same form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS_PER_PIECE = 4096  # files of one list in one nested row
ROWS_PER_BLOCK = 1024  # requirement rows whose sections share an object
FILES_PER_BLOCK = 1024  # files of a repository in one object
PAYLOAD_BYTES = 64 * 2**20  # encoded files of one part of a combined payload
ENTRY_BYTES = 64  # what a file has in its object besides name and content
_PARTS = 2**31  # pieces of a block stay below this


def _files(kind: str) -> Column:
    return F.array_sort(
        F.collect_list(F.when((F.col("kind") == kind) & F.col("pos").isNotNull(), F.struct("pos", "file_name", "score")))
    )


def nest_results(results: DataFrame, pairs: int = PAIRS_PER_PIECE) -> DataFrame:
    """``repo_id, section_name, first_row, piece, result`` with
    ``result = struct<common_files, only_one_model>`` of (file_name, score)."""
    piece = F.coalesce(F.floor((F.col("pos") - 1) / pairs), F.lit(0)).alias("piece")
    lists = results.groupBy("repo_id", "section_name", "first_row", piece).agg(
        _files("common_files").alias("common"), _files("only_one_model").alias("only")
    )

    def drop_pos(pair: Column) -> Column:
        return F.struct(pair["file_name"].alias("file_name"), pair["score"].alias("score"))

    return lists.select(
        "repo_id",
        "section_name",
        "first_row",
        "piece",
        F.struct(
            F.transform("common", drop_pos).alias("common_files"), F.transform("only", drop_pos).alias("only_one_model")
        ).alias("result"),
    )


def _quoted(text: Column) -> Column:
    """A JSON string: the one element of a JSON array without its brackets."""
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1")


def _pairs_json(pairs: Column) -> Column:
    texts = F.transform(
        pairs, lambda p: F.concat(F.lit("["), _quoted(p["file_name"]), F.lit(","), p["score"].cast("string"), F.lit("]"))
    )
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _object(entries: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: e["text"]), ","), F.lit("}"))


def result_lines(results: DataFrame, pairs: int = PAIRS_PER_PIECE) -> DataFrame:
    """``repo_id, section_name, first_row, piece, line``: a JSON object per section and run of ``pairs`` files.

    The form is the same at every size. Each object tells the section's
    ``first_row`` and how many files of each list come ``offset`` before it.
    """
    entry = F.concat(
        F.lit("{"),
        _quoted(F.col("section_name")),
        F.lit(':{"common_files":'),
        _pairs_json(F.col("result.common_files")),
        F.lit(',"only_one_model":'),
        _pairs_json(F.col("result.only_one_model")),
        F.lit(',"first_row":'),
        F.col("first_row").cast("string"),
        F.lit(',"offset":'),
        (F.col("piece") * pairs).cast("string"),
        F.lit("}}"),
    )
    return nest_results(results, pairs).select("repo_id", "section_name", "first_row", "piece", entry.alias("line"))


def result_documents(results: DataFrame, pairs: int = PAIRS_PER_PIECE, rows: int = ROWS_PER_BLOCK) -> DataFrame:
    """``repo_id, block, piece, document``: a JSON object by section.

    Files are ``["name", score]`` pairs and sections come in first-seen order.
    """
    entry = F.concat(
        _quoted(F.col("section_name")),
        F.lit(':{"common_files":'),
        _pairs_json(F.col("result.common_files")),
        F.lit(',"only_one_model":'),
        _pairs_json(F.col("result.only_one_model")),
        F.lit("}"),
    )
    entries = nest_results(results, pairs).select(
        "repo_id", F.floor(F.col("first_row") / rows).alias("block"), "piece", "first_row", entry.alias("text")
    )
    return entries.groupBy("repo_id", "block", "piece").agg(
        _object(F.collect_list(F.struct("first_row", "text"))).alias("document")
    )


def byte_blocks(tree: DataFrame, max_bytes: int) -> DataFrame:
    """Add ``block``: runs of a repository's files, in order, whose encoded sizes add up to at most ``max_bytes``.

    A file larger than half of that has a block of its own. Sizes are added up
    over runs of ``FILES_PER_BLOCK`` positions first, so no task sees more of a
    repository than such a run, or one number per run.
    """
    size = F.octet_length("content") + F.octet_length("path") + ENTRY_BYTES
    sized = tree.withColumn("_size", F.coalesce(size, F.lit(ENTRY_BYTES)).cast("long")).withColumn("_run", F.floor(F.col("pos") / FILES_PER_BLOCK))
    earlier = Window.partitionBy("repo_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("repo_id", "_run").agg(F.sum("_size").alias("_sum"))
    offsets = sums.select("repo_id", "_run", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("repo_id", "_run").orderBy("pos", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(offsets, ["repo_id", "_run"])
    half = max(1, max_bytes // 2)
    # What begins in one half fits into the whole; at most one large file begins there.
    block = F.floor((F.col("_offset") + F.col("_before")) / half) * 2 + F.when(F.col("_size") > half, 1).otherwise(0)
    return placed.withColumn("block", block.cast("long")).select(*tree.columns, "block")


def tree_documents(tree: DataFrame, files: int = FILES_PER_BLOCK, max_bytes: int | None = None) -> DataFrame:
    """``repo_id, block, tree``: encoded files as a JSON object by name, of ``files`` positions or of at most ``max_bytes``."""
    blob = F.struct(F.lit("blob").alias("type"), F.lit("base64").alias("encode"), "content")
    if max_bytes is None:
        blocked = tree.withColumn("block", F.floor(F.col("pos") / files))
    else:
        blocked = byte_blocks(tree, max_bytes)
    return (
        blocked.select("repo_id", "block", "pos", F.concat(_quoted(F.col("path")), F.lit(":"), F.to_json(blob)).alias("text"))
        .groupBy("repo_id", "block")
        .agg(_object(F.collect_list(F.struct("pos", "text"))).alias("tree"))
    )


def combined_payload(results: DataFrame, tree: DataFrame, files: int | None = None, max_bytes: int = PAYLOAD_BYTES) -> DataFrame:
    """``repo_id, part, payload``: ``{"rag_output": ..., "repo_files": ...}``.

    The first result object of a repository travels with its first files, and
    so on while both last; the rest goes with an empty object. The files of a
    part have at most ``max_bytes``, unless one file alone has more; with
    ``files`` they are cut by that many positions instead. The parts
    are computed from the blocks, so nothing of a repository comes together in
    one task.
    """
    empty = F.lit("{}")
    documents = result_documents(results).withColumn("part", F.col("block") * _PARTS + F.col("piece"))
    blocks = tree_documents(tree, max_bytes=max_bytes) if files is None else tree_documents(tree, files)
    trees = blocks.withColumn("part", F.col("block"))
    return (
        documents.select("repo_id", "part", "document")
        .join(trees.select("repo_id", "part", "tree"), ["repo_id", "part"], "full")
        .select(
            "repo_id",
            "part",
            F.concat(
                F.lit('{"rag_output":'),
                F.coalesce("document", empty),
                F.lit(',"repo_files":'),
                F.coalesce("tree", empty),
                F.lit("}"),
            ).alias("payload"),
        )
    )
