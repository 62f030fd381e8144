"""Readers of the files the jobs start from.

Order matters to the results and Spark keeps none, so each reader gives its
rows a position to sort by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceline import schemas
from traceline.functions.codec import with_decoded
from traceline.functions.text import is_source_file
from traceline.operators.ranking import number_rows
from traceline.sources.json_object import read_json_entries

# Positions of one piece of a repository stay below this.
_PIECE = 2**31
_FILE_BYTES = 2**44  # bytes of one file stay below this


def _unescaped(text: Column) -> Column:
    """Percent escapes of file and folder names; a plus sign stands for itself."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _with_path(df: DataFrame) -> DataFrame:
    return df.select("value", _unescaped(F.col("_metadata.file_path")).alias("file_path"))


def read_table(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """A Parquet table for work that is heavy per row, such as embedding.

    A scan in fewer splits than there are cores is a small table or one of few
    row groups; its rows are dealt out by ``key``. Any other is read as it lies.
    """
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, *key) if rows.rdd.getNumPartitions() < cores else rows


def _entries(df: DataFrame, map_column: str, *ids: str) -> DataFrame:
    """``pos, key, value`` of a parsed JSON object.

    A repeated key keeps its first place and its last value. The parser leaves
    repeats in, and looking for them costs one pass unless there are some.
    """
    keys, values = F.map_keys(map_column), F.map_values(map_column)

    def last(key: Column) -> Column:
        return F.get(values, F.size(map_column) - F.array_position(F.reverse(keys), key).cast("int"))

    settled = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), last(k).alias("value")))
    unique = F.size(F.array_distinct(keys)) == F.size(map_column)
    entries = F.when(unique, F.map_entries(map_column)).otherwise(settled)
    return df.select(*ids, F.posexplode(entries).alias("pos", "_entry")).select(*ids, "pos", "_entry.key", "_entry.value")


def read_repo_tree(spark: SparkSession, path: str, repo_id: str | None = None, range_bytes: int | None = None) -> DataFrame:
    """Files holding one JSON object each, name to blob.

    Without ``repo_id`` the repository is the ``repo_id=`` folder of the file,
    and a ``part=`` folder places the pieces of a large one. A file is one row
    to a task, unless ``range_bytes`` has it read in ranges of that size, which
    objects beyond 2 GB need; ``pos`` is then the place in the file in bytes.
    """
    if range_bytes is not None:
        return _tree_ranges(spark, path, repo_id, range_bytes)
    text = _with_path(spark.read.text(path, wholetext=True))
    folder = _unescaped(F.regexp_extract("file_path", "/repo_id=([^/]*)/", 1))
    part = F.coalesce(F.try_to_number(F.regexp_extract("file_path", "/part=([0-9]+)/", 1), F.lit("9999999999")), F.lit(0))
    parsed = text.select(
        (folder if repo_id is None else F.lit(repo_id)).alias("repo_id"),
        part.cast("long").alias("part"),
        F.from_json("value", schemas.REPO_TREE).alias("tree"),
    )
    return _tree_rows(parsed)


def _tree_ranges(spark: SparkSession, path: str, repo_id: str | None, range_bytes: int) -> DataFrame:
    file = _unescaped(F.col("file"))
    folder = F.regexp_extract(file, "/repo_id=([^/]*)/", 1) if repo_id is None else F.lit(repo_id)
    part = F.coalesce(F.try_to_number(F.regexp_extract(file, "/part=([0-9]+)/", 1), F.lit("9999999999")), F.lit(0)).cast("long")
    entries = read_json_entries(spark, path, range_bytes)
    # A repeated name keeps its first place and its last value.
    last = entries.groupBy("file", "key").agg(F.min("at").alias("at"), F.max_by("value", "at").alias("value"))
    blob = F.from_json("value", schemas.BLOB)
    return last.select(folder.alias("repo_id"), (part * _FILE_BYTES + F.col("at")).alias("pos"), F.col("key").alias("path"), blob["content"].alias("content"))


def _tree_rows(parsed: DataFrame) -> DataFrame:
    return _entries(parsed, "tree", "repo_id", "part").select(
        "repo_id", (F.col("part") * _PIECE + F.col("pos")).alias("pos"), F.col("key").alias("path"), "value.content"
    )


def explode_payload(payload: DataFrame) -> DataFrame:
    """One row per file of ``{id, repository_tree}`` rows, batch or stream."""
    return _tree_rows(
        payload.select(
            F.col("id").alias("repo_id"), F.coalesce("part", F.lit(0)).alias("part"), F.col("repository_tree").alias("tree")
        )
    )


def read_payload(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Payload files; with ``multiline=False`` one object per line, which splits."""
    return explode_payload(spark.read.schema(schemas.PAYLOAD).option("multiLine", multiline).json(path))


def decode_files(tree: DataFrame, on_error: str = "fail", spread: bool = False) -> DataFrame:
    """Keep source files and decode them to ``content``.

    ``fail`` ends the job on the first bad file; ``null`` leaves ``content``
    NULL and says why in ``error``. ``spread`` deals the files of one large
    payload out to all tasks before the work on the texts starts.
    """
    if on_error not in ("fail", "null"):
        raise ValueError(f"unknown on_error {on_error!r}")
    kept = tree.where(is_source_file(F.col("path")))
    if spread:
        kept = kept.repartition("repo_id", "path")
    decoded = with_decoded(kept, "content", "_text", "error")
    columns = ["repo_id", "pos", "path", F.col("_text").alias("content")]
    if on_error == "null":
        return decoded.select(*columns, "error")
    failed = F.raise_error(F.concat(F.lit("cannot decode "), F.col("path"), F.lit(": "), F.col("error")))
    checked = F.when(F.col("error").isNull(), F.col("_text")).otherwise(failed.cast("string"))
    return decoded.withColumn("_text", checked).select(*columns)


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """Requirements CSV with quoted fields, numbered 0, 1, 2 ... in file order."""
    rows = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
        .select("section_name", "req_description", "_metadata.file_path")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return number_rows(rows, [], ["file_path", "_at"], "row_idx", start=0).select("row_idx", "section_name", "req_description")


def read_directory(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """Every file of a directory as ``repo_id, path, content``.

    The path is relative to the directory, which also names the repository.
    """
    root = directory.rstrip("/")
    text = _with_path(spark.read.text(root, wholetext=True, recursiveFileLookup=recursive))
    start = F.instr("file_path", f"{root}/") + len(root) + 1
    inside = F.substr("file_path", start)
    return text.select(F.lit(root).alias("repo_id"), inside.alias("path"), F.col("value").alias("content"))


def read_results(spark: SparkSession, path: str | list[str], layout: str = "lines") -> DataFrame:
    """Result files of any number of models in one scan, as a long table.

    ``lines`` files are those of ``write_result_json``: an object per line,
    which may continue a section. ``document`` files hold one object each,
    printed in any way. Text that is not one object raises an error. The model is the file's name
    without ``section_result_`` and ``.json``, or the ``model=`` folder it is in.
    """
    if layout not in ("document", "lines"):
        raise ValueError(f"unknown layout {layout!r}")
    text = _with_path(spark.read.text(path, wholetext=layout == "document"))
    folder = _unescaped(F.regexp_extract("file_path", "/model=([^/]*)/", 1))
    name = F.regexp_replace(F.substring_index("file_path", "/", -1), r"^section_result_|\.json$", "")
    value = F.col("value")
    alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))), F.lit(0)) == 1
    blank = (F.trim(value) == "") & F.lit(layout == "lines")
    wrong = F.concat(F.lit(f"not one JSON object (layout {layout!r}): "), "file_path")
    value = F.when(alone | blank, value).otherwise(F.raise_error(wrong))
    parsed = text.select(
        F.when(folder != "", folder).otherwise(name).alias("model"),
        F.from_json(value, schemas.RESULT_DOCUMENT).alias("sections"),
    )
    sections = _entries(parsed, "sections", "model").toDF("model", "first_row", "section_name", "lists")
    return result_pairs(sections.withColumn("first_row", F.coalesce("lists.first_row", "first_row")))


def result_pairs(sections: DataFrame) -> DataFrame:
    """Pair lists to one row per file; an empty section keeps a row without file."""

    def tagged(kind: str) -> Column:
        pairs = F.coalesce(F.col(f"lists.{kind}"), F.array())
        place = F.coalesce(F.col("lists.offset"), F.lit(0)) + 1
        return F.transform(pairs, lambda p, i: F.struct(F.lit(kind).alias("kind"), (i + place).alias("pos"), p.alias("p")))

    pairs = F.explode_outer(F.concat(tagged("common_files"), tagged("only_one_model"))).alias("f")
    keys = [c for c in sections.columns if c != "lists"]
    return sections.select(*keys, pairs).select(
        *keys, "f.kind", "f.pos", F.col("f.p")[0].alias("file_name"), F.col("f.p")[1].cast("double").alias("score")
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Confusion metrics CSV; an empty cell is NULL."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(schemas.METRICS).csv(path)
