"""Entries of one JSON object of any size, read in byte ranges.

Whether a byte of a range is inside a string, and how deep, depends on all bytes
before it. Each range is therefore run through once for each of the three ways
it may begin, which gives how it would end; chained from the start of the file,
a few numbers per range, this tells how every range does begin. In a second
pass each range cuts out the entries whose keys begin in it, reading on beyond
its end as far as the last one goes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceline.runtime import stored

RANGE_BYTES = 64 * 2**20
READ_ON = 2**20  # bytes read at once beyond the end of a range, or its own size if that is less
TASKS_A_CORE = 4
OUTSIDE, INSIDE, ESCAPED = range(3)  # ESCAPED: inside, and the next byte is escaped

_QUOTE, _BACKSLASH, _COMMA, _COLON = (ord(c) for c in '"\\,:')
_OPEN, _CLOSE = [ord(c) for c in "{["], [ord(c) for c in "}]"]
_BLANKS = [ord(c) for c in " \t\r\n"]


def _scan(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(unescaped quotes, bytes that are outside strings, depth after each byte, state at the end)."""
    at = np.arange(len(data))
    slash = data == _BACKSLASH
    last = np.maximum.accumulate(np.where(slash, -1, at))  # the last byte that is no backslash
    run = np.where(last >= 0, at - last, at + 1 + (state == ESCAPED))  # backslashes up to here
    odd = run % 2 == 1
    escaped = np.concatenate([[state == ESCAPED], odd[:-1]]) if len(data) else odd
    quote = (data == _QUOTE) & ~escaped
    before = (np.cumsum(quote) - quote + (state != OUTSIDE)) % 2 == 1
    outside = ~before & ~quote
    depth = np.cumsum(np.where(outside, np.isin(data, _OPEN).astype(np.int64) - np.isin(data, _CLOSE), 0))
    inside = bool((int(quote.sum()) + (state != OUTSIDE)) % 2)
    end = OUTSIDE if not inside else ESCAPED if len(data) and odd[-1] else INSIDE
    return quote, outside, depth, end if len(data) else state


def range_ends(data: bytes) -> list[tuple[int, int]]:
    """(state, depth gained) at the end of a range, for each state it may begin in."""
    found = (_scan(np.frombuffer(data, np.uint8), state) for state in (OUTSIDE, INSIDE, ESCAPED))
    return [(end, int(depth[-1]) if len(depth) else 0) for _, _, depth, end in found]


def cut_entries(data: bytes, limit: int, state: int, depth: int, final: bool) -> list[tuple[int, bytes, bytes]] | None:
    """(place, key, value) of the entries whose keys begin before ``limit``; None if ``data`` ends before the last of them does.

    ``data`` begins in ``state`` at ``depth``; ``final`` says that nothing follows it.
    """
    bytes_ = np.frombuffer(data, np.uint8)
    quote, outside, gained, _ = _scan(bytes_, state)
    deep = depth + gained
    quotes = np.flatnonzero(quote)
    # Opening and closing quotes take turns; in the middle of a string the first one closes it.
    opening = quotes[(state != OUTSIDE) :: 2]
    closing = quotes[(state != OUTSIDE) ^ 1 :: 2]
    closing = closing[1:] if len(closing) and len(opening) and closing[0] < opening[0] else closing
    opening = opening[(deep[opening] == 1) & (opening < limit)] if len(opening) else opening
    solid = np.flatnonzero(~np.isin(bytes_, _BLANKS))
    ends = np.flatnonzero(outside & ((bytes_ == _COMMA) & (deep == 1) | np.isin(bytes_, _CLOSE) & (deep == 0)))
    out = []
    for start in opening.tolist():
        close = int(np.searchsorted(closing, start))
        follow = int(np.searchsorted(solid, closing[close], side="right")) if close < len(closing) else len(solid)
        if follow >= len(solid):
            if final:
                raise ValueError("the JSON object ends inside an entry")
            return None
        colon = int(solid[follow])
        if bytes_[colon] != _COLON:
            continue  # a string that is a value
        end = int(np.searchsorted(ends, colon))
        if end >= len(ends):
            if final:
                raise ValueError("the JSON object ends inside an entry")
            return None
        out.append((start, data[start : closing[close] + 1], data[colon + 1 : ends[end]].strip()))
    return out


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """``file, start, size`` of all files under ``path``; nothing is read of them."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("length > 0").select("file", "length", starts.alias("start"))
    return ranges.select("file", "start", F.least(F.lit(range_bytes).cast("long"), F.col("length") - F.col("start")).alias("size"))


def read_json_entries(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, at, key, value``: the entries of each file's object, the value as JSON text, ``at`` the byte its key begins at.

    Paths must be ones that Arrow opens on the executors (a shared folder, or a
    store it knows). Files that hold anything but one object raise.
    """
    ranges = _ranges(spark, path, range_bytes)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ends = []
            for r in rows:
                fs, name = _opened(r["file"])
                with fs.open_input_file(name) as f:
                    data = f.read_at(r["size"], r["start"])
                if r["start"] == 0 and data.lstrip(b" \t\r\n")[:1] not in (b"{", b""):
                    raise ValueError(f"not a JSON object: {r['file']}")
                ends.append(range_ends(data))
            columns = [[e[s][i] for e in ends] for s in range(3) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in columns]], names=[*batch.schema.names, *_ENDS])

    _ENDS = [f"{kind}{s}" for s in range(3) for kind in ("state", "depth")]
    schema = "file string, start long, size long, " + ", ".join(f"{c} long" for c in _ENDS)
    # A row stands for much to read, so the number of tasks is told, not left to the size of the rows.
    tasks = _tasks(ranges)
    scanned = ranges.repartition(tasks, "file", "start").mapInArrow(states, schema)

    def chained(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start")
        ends = [list(zip(rows.column(f"state{s}").to_pylist(), rows.column(f"depth{s}").to_pylist())) for s in range(3)]
        state, depth, begun = OUTSIDE, 0, []
        for i in range(rows.num_rows):
            begun.append((state, depth))
            state, depth = ends[state][i][0], depth + ends[state][i][1]
        _complete(rows.column("file")[0].as_py(), state, depth)
        columns = [pa.array([b[0] for b in begun], pa.int32()), pa.array([b[1] for b in begun], pa.int64())]
        return pa.table([*rows.select(["file", "start", "size"]).columns, *columns], names=["file", "start", "size", "state", "depth"])

    # Seven numbers a range come together for a file: 64 MiB of input are one row here.
    begun = stored(scanned.groupBy("file").applyInArrow(chained, "file string, start long, size long, state int, depth long"), "ranges")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, name = _opened(r["file"])
                with fs.open_input_file(name) as f:
                    length, size = f.size(), r["size"]
                    data, found, more = f.read_at(size, r["start"]), None, min(READ_ON, size)
                    while found is None:
                        final = r["start"] + len(data) >= length
                        found = cut_entries(data, size, r["state"], r["depth"], final)
                        if found is None:
                            data += f.read_at(more, r["start"] + len(data))
                            more *= 2
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["file"]] * len(found), pa.string()),
                        pa.array([r["start"] + at for at, _, _ in found], pa.int64()),
                        pa.array([json.loads(key) for _, key, _ in found], pa.string()),
                        pa.array([value.decode() for _, _, value in found], pa.string()),
                    ],
                    names=["file", "at", "key", "value"],
                )

    return begun.repartition(tasks, "file", "start").mapInArrow(entries, "file string, at long, key string, value string")


def _tasks(ranges: DataFrame) -> int:
    """A few tasks a core and at least one for each ``RANGE_BYTES``, but no more than there are ranges."""
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return max(1, min(n, max(TASKS_A_CORE * ranges.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))))


def _complete(file: str | None, state: int, depth: int) -> None:
    if state != OUTSIDE or depth != 0:
        raise ValueError(f"the JSON object is not complete: {file}")
