"""Files of token ids in the order of documents, and their reader.

Documents are range-sorted by key, encoded by a tokenizer file and written as
frames (``range_coder``) of whole documents through Spark's own writer, which
commits each task's file once and works on any file system. A row is a frame:
its place (``part``, ``frame``), the keys and lengths of its documents, and the
coded ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceline.llm import range_coder
from traceline.llm.texts import text_slices
from traceline.llm.tokens import tokenizer

FRAME = 1 << 22  # ids from which a frame is closed
END = 1


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end: int = END, key: str = "doc_id", text: str = "text", frame: int = FRAME) -> None:
    """Write the ids of every text (NULL: empty), each followed by ``end``, in ascending key order, NULL first.

    Rows with equal keys stay together in any order. One document's ids have to
    fit in a task.
    """
    kind = docs.schema[key].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = tokenizer(tokenizer_file), end.to_bytes(4, "little")
        part, number = TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        waiting: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            whole = pa.chunked_array(keys).combine_chunks()
            offsets = pa.array([0, len(waiting)], pa.int32())
            lengths = pa.array([len(ids) // 4 for ids in waiting], pa.int64())
            payload = range_coder.encode(np.frombuffer(b"".join(waiting), "<u4"))
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32())]
            columns += [pa.ListArray.from_arrays(offsets, whole), pa.ListArray.from_arrays(offsets, lengths)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([payload], pa.binary())], names=names)

        for piece in text_slices(batches, 1):
            ids = [done + last for done in coder.encode_column(piece.column(1))]
            keys.append(piece.column(0))
            waiting += ids
            held += sum(map(len, ids)) // 4
            if held >= frame:
                yield closed()
                keys, waiting, held, number = [], [], 0, number + 1
        if waiting:
            yield closed()

    names = ["part", "frame", "keys", "lengths", "payload"]
    ordered = docs.select(key, text).repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first())
    schema = f"part int, frame int, keys array<{kind.simpleString()}>, lengths array<bigint>, payload binary"
    ordered.mapInArrow(task, schema).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``key, start, n_tokens, ids_crc32, ids`` of every document, from the files alone.

    ``start`` counts the ids of all documents before. Damage raises an error.
    Without ``with_ids`` the ids are read, too, but not handed to Spark.
    """
    frames = spark.read.parquet(path)
    kind = frames.schema["keys"].dataType.elementType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = range_coder.decode(row.column("payload")[0].as_py())
                lengths = row.column("lengths").flatten().to_numpy()
                if lengths.sum() != len(ids):
                    raise ValueError("a frame's documents do not add up to its ids")
                ends = np.cumsum(lengths)
                ids = ids.astype("<u4", copy=False)
                bounds = ends.tolist()
                raw = [ids[a:b] for a, b in zip([0, *bounds], bounds)]
                columns = [
                    row.column("part").take(pa.array(np.zeros(len(raw), np.int64))),
                    row.column("frame").take(pa.array(np.zeros(len(raw), np.int64))),
                    row.column("keys").flatten(),
                    pa.array(ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([r.tobytes() for r in raw], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", "frame", key, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = f"part int, frame int, `{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    documents = frames.mapInArrow(task, schema)
    sizes = frames.select("part", "frame", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("_n"))
    # Frames are numbered inside their part; only one total per part meets in one task.
    inside = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("_n").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part"))
    offsets = sizes.select("part", "frame", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_frame")).join(parts, "part")
    return documents.join(offsets, ["part", "frame"]).select(
        key, (F.col("start") + F.col("_frame") + F.col("_part")).alias("start"), *names[4:]
    )
