"""Removal of long byte strings that an earlier document holds.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts
in a document with a smaller key. Matches are decided by the suffix order of
shards, made by external induced sorting (``induced_sort``).

1. Documents are gathered into blocks of a few megabytes, written once.
2. Each string of ``LENGTH`` bytes has an anchor, the least hash of its
   ``ANCHOR``-byte parts; equal strings have equal anchors. A block sends each
   anchor once, and anchors that a second document shares come back to it.
   Whatever has no such anchor is unique and is not looked at again.
3. The strings under a shared anchor go as short contexts to the shard of the
   anchor, equal contexts of a block once. An anchor found in very many
   documents is split: each of its strings goes to a shard of its own hash.
4. A shard sorts its suffixes, finds runs of equal strings and their smallest
   key, and answers each block with one bit per string.
5. Blocks remove what the bits cover.

Every group that meets in a task is bounded: a block, a range of anchors (each
anchor at most once per block), or a shard (see ``HOT``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceline.llm.induced_sort import equal_runs, suffix_order
from traceline.llm.texts import slices
from traceline.runtime import fresh_path, stored

LENGTH = 50
ANCHOR = 20
BLOCK = 2 * 2**20  # bytes of text in a block
PIECE = 2**18  # bytes hashed at once
RANGE = 8 * 2**20  # bytes of text per range of anchors
SHARD = 6 * 2**20  # bytes of text per shard
LEVEL = 5  # of compression: blocks are written once and move twice
HOT = 4096  # documents that share an anchor from which it is split

_COUNT = np.uint64(15)  # low bits of an anchor that tell in how many documents of a block it is
_BASE = 0x9E3779B97F4A7C15
_PARTS = "block string, data binary, keys array<bigint>, lengths array<int>"


def _window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each position on, put together from powers of two."""
    chunk = data.astype(np.uint64) + np.uint64(1)
    factor, size, done, out = _BASE, 1, 0, None
    while True:
        if width & size:
            n = len(data) - done - size + 1
            out = chunk[:n] if out is None else out[:n] * np.uint64(factor) + chunk[done : done + n]
            done += size
        size *= 2
        if size > width:
            break
        half = size // 2
        chunk = chunk[:-half] * np.uint64(factor) + chunk[half:]
        factor = factor * factor % 2**64
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchor_runs(data: np.ndarray, lengths: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """``start, count, document, hash`` of runs of neighbouring strings with one anchor.

    ``data`` holds the documents one after the other; no string crosses two.
    """
    ends = np.cumsum(lengths)
    found = []
    first = 0
    while first < len(lengths):
        begin = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        stop = ends[last - 1]
        if stop - begin >= length:
            least = _sliding_minimum(_window_hashes(data[begin:stop], anchor), length - anchor + 1)
            document = np.repeat(np.arange(first, last), lengths[first:last])
            inside = document[: len(least)] == document[length - 1 :]
            new = inside.copy()
            new[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (document[1 : len(least)] != document[: len(least) - 1])
            start = np.flatnonzero(new)
            total = np.append(0, np.cumsum(inside))
            count = np.diff(total[np.append(start, len(least))])
            found.append((start + begin, count, document[start], least[start] & ~_COUNT))
        first = last
    if not found:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    return [np.concatenate(column) for column in zip(*found)]


def _unpacked(row: dict) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.decompress(row["data"])
    keys = np.array([np.iinfo(np.int64).max if k is None else k for k in row["keys"]], np.int64)
    null = np.array([k is None for k in row["keys"]], bool)
    return data, keys, np.array(row["lengths"], np.int64), null


def _packed(marks: np.ndarray) -> bytes:
    """Rising numbers as compressed byte planes of their differences."""
    steps = np.diff(marks, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _marks(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _blocks(docs: DataFrame, key: str, text: str, carry: list[str], size: int) -> DataFrame:
    """Blocks of compressed documents with their keys, lengths and carried columns."""
    rest = T.StructType([docs.schema[name] for name in carry])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for part in slices(batches, 200):
            waiting.append(part)
            held += part.column(1).nbytes
            if held >= size:
                yield block(waiting)
                waiting, held = [], 0
        if waiting:
            yield block(waiting)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        texts = [t or b"" for t in table.column(1).cast(pa.binary()).to_pylist()]
        offsets = pa.array([0, len(texts)], pa.int32())
        keys = pa.ListArray.from_arrays(offsets, table.column(0).combine_chunks())
        lengths = pa.ListArray.from_arrays(offsets, pa.array([len(t) for t in texts], pa.int32()))
        columns = [pa.array([uuid.uuid4().hex]), pa.array([zstandard.compress(b"".join(texts), LEVEL)], pa.binary()), keys, lengths]
        names = ["block", "data", "keys", "lengths"]
        if carry:
            others = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in carry], carry)
            columns.append(pa.ListArray.from_arrays(offsets, others))
            names.append("rest")
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType.fromDDL(_PARTS)
    if carry:
        schema = schema.add("rest", T.ArrayType(rest))
    return docs.select(F.col(key).cast("long").alias(key), text, *carry).mapInArrow(task, schema)


def _anchors(blocks: DataFrame, bits: int) -> DataFrame:
    """``range, block, anchors``: each anchor of a block once, with its number of documents in the low bits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, _, lengths, null = _unpacked(row)
                _, _, document, mark = anchor_runs(np.frombuffer(data, np.uint8), lengths)
                mark, document = mark[~null[document]], document[~null[document]]
                order = np.argsort(mark, kind="stable")
                mark, document = mark[order], document[order]
                new = np.append(True, mark[1:] != mark[:-1])[: len(mark)]
                other = new | np.append(True, document[1:] != document[:-1])[: len(mark)]
                starts = np.flatnonzero(new)
                many = np.add.reduceat(other, starts) if len(starts) else np.zeros(0, np.int64)
                mark = mark[starts] | np.minimum(np.frexp(many.astype(float))[1], 15).astype(np.uint64)
                place = (mark >> np.uint64(64 - bits)).astype(np.int64)
                kinds, first = np.unique(place, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(kinds.astype(np.int32)),
                        pa.array([row["block"]] * len(kinds)),
                        pa.array([_packed(part) for part in np.split(mark, first[1:])][: len(kinds)], pa.binary()),
                    ],
                    names=["range", "block", "anchors"],
                )

    return blocks.select("block", "data", "keys", "lengths").mapInArrow(task, "range int, block string, anchors binary")


def _shared(anchors: DataFrame, hot: int) -> DataFrame:
    """``block, range, shared, split``: a bit per anchor sent, set if a second document has it, and if it is split."""

    def group(table: pa.Table) -> pa.Table:
        parts = [_marks(part) for part in table.column("anchors").to_pylist()]
        mark = np.concatenate(parts)
        order = np.argsort(mark, kind="stable")
        value, many = mark[order] & ~_COUNT, (mark[order] & _COUNT).astype(np.int64)
        place = np.cumsum(np.append(True, value[1:] != value[:-1])) - 1
        documents = np.zeros(len(mark))
        documents[order] = np.bincount(place, 2.0 ** (many - 1))[place]  # at least that many, exact for one
        bounds = np.cumsum([0] + [len(part) for part in parts])
        bits = [[np.packbits(documents[low:high] >= least).tobytes() for low, high in zip(bounds, bounds[1:])] for least in (2, hot)]
        columns = [table.column("block"), table.column("range"), *[pa.array(flags, pa.binary()) for flags in bits]]
        return pa.table(columns, names=["block", "range", "shared", "split"])

    return anchors.groupBy("range").applyInArrow(group, "block string, range int, shared binary, split binary")


def _contexts(blocks: DataFrame, shared: DataFrame, bits: int, shards: int) -> DataFrame:
    """Contexts for the shards (``shard >= 0``) and what a block has to remember (``shard = -1``)."""

    def group(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        row = next(r for r in rows if r["data"] is not None)
        data, keys, lengths, null = _unpacked(row)
        start, count, document, mark = anchor_runs(np.frombuffer(data, np.uint8), lengths)
        # The anchors in the order in which they were sent, range by range.
        sent = np.unique(mark[~null[document]])
        place = sent >> np.uint64(64 - bits)
        answers = sorted((r["range"], r["shared"], r["split"]) for r in rows if r["data"] is None)
        wide = [int((place == np.uint64(number)).sum()) for number, _, _ in answers]
        common, often = (
            np.concatenate([np.zeros(0, np.uint8)] + [np.unpackbits(np.frombuffer(a[i], np.uint8), count=n) for a, n in zip(answers, wide)])
            for i in (1, 2)
        )
        at = np.minimum(np.searchsorted(sent, mark), max(0, len(sent) - 1))
        use = (common[at] == 1) & ~null[document] if len(sent) else np.zeros(len(mark), bool)
        start, count, document, mark = start[use], count[use], document[use], mark[use]
        split = often[at[use]].astype(bool) if len(sent) else np.zeros(0, bool)
        if split.any():  # every string of a split anchor stands alone
            times = np.where(split, count, 1)
            inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start, document, mark = np.repeat(start, times) + inside, np.repeat(document, times), np.repeat(mark, times)
            split = np.repeat(split, times)
            count = np.where(split, 1, np.repeat(count, times))
        numbers: dict[bytes, int] = {}
        number = np.fromiter(
            (numbers.setdefault(data[s : s + n], len(numbers)) for s, n in zip(start.tolist(), (count + LENGTH - 1).tolist())),
            np.int64,
            len(start),
        )
        texts = list(numbers)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, number, keys[document])
        shard = np.zeros(len(texts), np.int64)
        shard[number] = ((mark >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
        for i in np.unique(number[split]).tolist():
            shard[i] = xxhash.xxh64_intdigest(texts[i]) % shards
        state = b"".join(a.astype(np.int64).tobytes() for a in (np.array([len(start), len(texts)]), start, count, number, least))
        out = [(-1, row["block"], zstandard.compress(state, LEVEL), None, None, None)]
        order = np.argsort(shard, kind="stable")
        kinds, first = np.unique(shard[order], return_index=True)
        for kind, members in zip(kinds.tolist(), np.split(order, first[1:])):
            chosen = [texts[i] for i in members.tolist()]
            sizes = np.array([len(t) for t in chosen], np.int32)
            packed = zstandard.compress(b"".join(chosen), LEVEL)
            out.append((kind, row["block"], packed, sizes.tobytes(), least[members].tobytes(), members.astype(np.int32).tobytes()))
        names = ["shard", "block", "body", "sizes", "least", "numbers"]
        kinds_ = [pa.int32(), pa.string(), *[pa.binary()] * 4]
        return pa.table([pa.array(column, kind) for column, kind in zip(zip(*out), kinds_)], names=names)

    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("range", "int"), ("shared", "binary"), ("split", "binary"))]
    texts = blocks.select("block", "data", "keys", "lengths", *none)
    asked = shared.select(
        "block",
        F.lit(None).cast("binary").alias("data"),
        F.lit(None).cast("array<bigint>").alias("keys"),
        F.lit(None).cast("array<int>").alias("lengths"),
        "range",
        "shared",
        "split",
    )
    schema = "shard int, block string, body binary, sizes binary, least binary, numbers binary"
    return texts.union(asked).groupBy("block").applyInArrow(group, schema)


def earlier_starts(texts: list[bytes], least: np.ndarray) -> np.ndarray:
    """Smallest key that holds the string at each position of the joined texts.

    ``least`` is the smallest key per text. Positions where no whole string
    starts hold the greatest key. Texts are joined by one zero byte.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0" * (LENGTH + 8), np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    strings = np.zeros(len(data), bool)
    span = sizes - LENGTH + 1
    strings[np.repeat(begins - np.cumsum(span) + span, span) + np.arange(span.sum())] = True
    order = suffix_order(data, LENGTH)
    order = order[strings[order]]
    run = equal_runs(data, order, LENGTH)
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    owner = np.full(len(data), np.iinfo(np.int64).max)
    firsts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    owner[order] = np.minimum.reduceat(least[text_of[order]], firsts)[run]
    return owner


def _verdicts(contexts: DataFrame) -> DataFrame:
    """``block, numbers, bits``: one bit per string of each context, set when an earlier document has it."""

    def group(table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        entries = []
        for row in table.to_pylist():
            data, sizes = zstandard.decompress(row["body"]), np.frombuffer(row["sizes"], np.int32)
            stops = np.cumsum(sizes).tolist()
            ids = [numbers.setdefault(data[b - n : b], len(numbers)) for b, n in zip(stops, sizes.tolist())]
            entries.append((row["block"], np.array(ids), np.frombuffer(row["least"], np.int64), row["numbers"], sizes))
        texts = list(numbers)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        for _, ids, keys, _, _ in entries:
            np.minimum.at(least, ids, keys)
        owner = earlier_starts(texts, least)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        out = []
        for block, ids, keys, numbers_, lengths in entries:
            span = lengths.astype(np.int64) - LENGTH + 1
            place = np.repeat(begins[ids] - np.cumsum(span) + span, span) + np.arange(span.sum())
            out.append((block, numbers_, np.packbits(owner[place] < np.repeat(keys, span)).tobytes()))
        kinds = [pa.string(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["block", "numbers", "bits"])

    return contexts.groupBy("shard").applyInArrow(group, "block string, numbers binary, bits binary")


def _removed(blocks: DataFrame, states: DataFrame, verdicts: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """Each document's counts and kept bytes."""
    rest = blocks.schema["rest"].dataType.elementType.fields if carry else []
    schema = T.StructType.fromDDL(f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    schema = T.StructType([*schema.fields, *rest])

    def group(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        text = table.slice(kinds.index(0), 1)
        data, keys, lengths, _ = _unpacked(text.select(["data", "keys", "lengths"]).to_pylist()[0])
        state = np.frombuffer(zstandard.decompress(table.column("body")[kinds.index(1)].as_py()), np.int64)
        runs, texts = int(state[0]), int(state[1])
        start, count, number = state[2 : 2 + 3 * runs].reshape(3, runs)
        least = state[2 + 3 * runs :]
        span = np.zeros(texts, np.int64)
        span[number] = count
        base = np.cumsum(span) - span
        bits = np.zeros(int(span.sum()), bool)
        for i in np.flatnonzero(np.array(kinds) == 2).tolist():
            members = np.frombuffer(table.column("numbers")[i].as_py(), np.int32)
            mine = span[members]
            flags = np.unpackbits(np.frombuffer(table.column("body")[i].as_py(), np.uint8), count=int(mine.sum()))
            bits[np.repeat(base[members] - np.cumsum(mine) + mine, mine) + np.arange(mine.sum())] = flags
        ends = np.cumsum(lengths)
        document = np.searchsorted(ends, start, "right")
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gone = bits[np.repeat(base[number], count) + offset] | np.repeat(keys[document] > least[number], count)
        place = (np.repeat(start, count) + offset)[gone]
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, place, 1)
        np.add.at(change, place + LENGTH, -1)
        covered = np.cumsum(change[:-1]) > 0
        del change
        first = covered.copy()
        first[1:] &= ~covered[:-1]
        begins = ends - lengths
        first[begins[lengths > 0]] = covered[begins[lengths > 0]]
        counted = np.append(0, np.cumsum(covered)), np.append(0, np.cumsum(first))
        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        upto = ends - counted[0][ends]
        since = begins - counted[0][begins]
        columns = [
            text.column("keys").combine_chunks().flatten(),
            pa.array(lengths),
            pa.array(counted[0][ends] - counted[0][begins]),
            pa.array(counted[1][ends] - counted[1][begins]),
            pa.array([kept[a:b] for a, b in zip(since.tolist(), upto.tolist())], pa.binary()),
        ]
        if carry:
            columns += text.column("rest").combine_chunks().flatten().flatten()
        return pa.table(columns, names=schema.fieldNames())

    def none(kind: str, name: str):
        return F.lit(None).cast(kind).alias(name)

    extra = ["rest"] if carry else []
    kept_rest = blocks.schema["rest"].dataType.simpleString() if carry else ""
    rows = blocks.select("block", F.lit(0).alias("kind"), "data", "keys", "lengths", none("binary", "numbers"), none("binary", "body"), *extra)
    blank = [none("binary", "data"), none("array<bigint>", "keys"), none("array<int>", "lengths")]
    empty = [none(kept_rest, "rest")] if carry else []
    rows = rows.union(states.select("block", F.lit(1).alias("kind"), *blank, none("binary", "numbers"), "body", *empty))
    rows = rows.union(verdicts.select("block", F.lit(2).alias("kind"), *blank, "numbers", F.col("bits").alias("body"), *empty))
    return rows.groupBy("block").applyInArrow(group, schema)


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    carry: list[str] | None = None,
    hot: int = HOT,
    block: int = BLOCK,
) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept`` of every row, and the columns ``carry``.

    ``kept`` are the remaining bytes of the UTF-8 text; a character may be cut.
    A NULL text is empty. Rows with equal keys do not count as earlier than
    each other; rows with a NULL key are neither earlier nor later than any and
    keep everything. The key must be an integer.
    """
    carry = carry or []
    blocks = stored(_blocks(docs, key, text, carry, block), "blocks")
    size = blocks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    bits = max(5, (size // RANGE).bit_length())
    shards = max(24, size // SHARD)
    shared = _shared(_anchors(blocks, bits), hot)
    path = fresh_path(docs.sparkSession, "contexts")
    found = _contexts(blocks, shared, bits, shards)
    found.withColumn("state", F.col("shard") < 0).write.partitionBy("state").parquet(path)
    contexts = docs.sparkSession.read.schema(found.schema.add("state", "boolean")).parquet(path)
    verdicts = _verdicts(contexts.where("not state").drop("state"))
    return _removed(blocks, contexts.where("state"), verdicts, key, carry)


def dedup_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with repeats taken out of ``text``; other columns unchanged, ``n_chars`` counted anew.

    Bytes that no longer form a character are dropped. Documents left without
    text stay, with an empty one.
    """
    others = [c for c in docs.columns if c not in (key, "text")]
    # Under numbers, so that no name of a column can meet one of this module.
    values = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others, 1)]
    packed = docs.select(key, "text", F.struct(F.lit(0).alias("c0"), *values).alias("_rest"))
    found = remove_repeats(packed, key, carry=["_rest"])
    text = F.replace(F.expr("make_valid_utf8(cast(kept as string))"), F.lit("\ufffd"), F.lit(""))
    whole = F.when(F.col("n_removed") > 0, text).otherwise(F.col("kept").cast("string"))
    columns = {c: F.col("_rest")[f"c{i}"] for i, c in enumerate(others, 1)} | {key: F.col(key), "text": whole}
    if "n_chars" in others:
        columns["n_chars"] = F.length(whole).cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])
