"""Embedding of text columns with a named model.

A model is anything that turns a list of texts into vectors. It is loaded once
per Python worker and fed Arrow batches; a text it cannot embed gets a NULL
vector and the error. The built-in model hashes words, so it needs no download.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBEDDED = "struct<embedding: array<float>, error: string>"

# Bytes of ASCII letters (as lower-case ones) and digits; any other byte is 0 and ends a word.
_LETTERS = np.zeros(256, dtype=np.uint8)
_LETTERS[[c for c in range(128) if chr(c).isalnum()]] = [ord(chr(c).lower()) for c in range(128) if chr(c).isalnum()]

# MD5 (RFC 1321): additions and rotations of the 64 steps, and the word of the block each one takes.
_MD5_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_MD5_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], dtype=np.uint32).repeat(4, axis=0).reshape(4, 4, 4).ravel()
_MD5_PLACES = np.concatenate([np.arange(16) * step + start for step, start in ((1, 0), (5, 1), (3, 5), (7, 0))]) % 16
_MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)
_ONE_BLOCK = 55  # bytes that one block of MD5 holds

HASHED = 8192  # words hashed at once
CELLS = 2**21  # counts held at once by a hash model
SLICE_BYTES = 2**20  # bytes of texts whose words are held at once
SEEN_WORDS = 100_000  # words of more than one block whose buckets are remembered


def _vectors(rows: np.ndarray, missing: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array of equal-length rows, NULL where ``missing``."""
    sizes = np.where(missing, 0, rows.shape[1])
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    # A NULL offset marks a NULL list.
    offsets = pa.array(ends, mask=np.append(missing, False))
    return pa.ListArray.from_arrays(offsets, pa.array(rows[~missing].ravel(), type=kind))


def _release() -> None:
    """Give back what a batch took; a worker lives on, and waits, with all it once had."""
    pa.default_memory_pool().release_unused()


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.LargeStringArray]:
    """Text number and lower-cased letters and digits of every word of the texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    before = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    given = np.frombuffer(data, dtype=np.uint8)[before[0] : before[-1]] if data is not None and len(texts) else np.zeros(0, dtype=np.uint8)
    letters = _LETTERS[given]
    inside = letters > 0
    # A word starts after a break or with its text, and ends before the next start or break.
    starts, ends = inside.copy(), inside.copy()
    if len(given):
        bounds = np.unique(before - before[0])[1:-1]
        goes_on = inside[1:] & inside[:-1]
        goes_on[bounds - 1] = False
        starts[1:] &= ~goes_on
        ends[:-1] &= ~goes_on
    first = np.flatnonzero(starts)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - first)])
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters[inside]))
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, before - before[0]))) if len(texts) else np.zeros(0, dtype=np.int64)
    return row, words


def _md5(words: pa.LargeStringArray) -> np.ndarray:
    """The MD5 digests of words of at most ``_ONE_BLOCK`` bytes as four big-endian numbers each."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
    out = np.empty((4, len(words)), dtype=np.uint32)
    for start in range(0, len(words), HASHED):
        at = offsets[start : start + HASHED + 1]
        sizes = np.diff(at)
        n = len(sizes)
        block = np.zeros((n, 64), dtype=np.uint8)
        place = np.arange(at[-1] - at[0]) + np.repeat(np.arange(n) * 64 - (at[:-1] - at[0]), sizes)
        block.reshape(-1)[place] = data[at[0] : at[-1]]
        block[np.arange(n), sizes] = 0x80
        block.view("<u8")[:, 7] = sizes * 8
        parts = np.ascontiguousarray(block.view("<u4").T).astype(np.uint32)
        empty = ~parts.any(axis=1)
        a, b, c, d = (np.full(n, v, dtype=np.uint32) for v in _MD5_START)
        f, g = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            if i < 16:  # d ^ (b & (c ^ d))
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:  # c ^ (d & (b ^ c))
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:  # c ^ (b | ~d)
                np.bitwise_not(d, out=f)
                f |= b
                f ^= c
            f += a
            f += _MD5_ADDED[i]
            if not empty[_MD5_PLACES[i]]:
                f += parts[_MD5_PLACES[i]]
            np.left_shift(f, _MD5_TURNS[i], out=g)
            f >>= np.uint32(32 - _MD5_TURNS[i])
            f |= g
            f += b
            a, b, c, d, f = d, f, b, c, a
        for part, value, begin in zip(out, (a, b, c, d), _MD5_START):
            part[start : start + n] = value + begin
    return out.byteswap()


def _digits(digests: np.ndarray, first_digit: int) -> np.ndarray:
    """Eight hexadecimal digits of each digest from ``first_digit`` on, fewer where it ends, as a number."""
    part, at = divmod(first_digit, 8)
    parts = digests.astype(np.int64)
    if at == 0:
        return parts[part]
    head = parts[part] & ((1 << 4 * (8 - at)) - 1)
    return head if part == 3 else (head << 4 * at) | (parts[part + 1] >> 4 * (8 - at))


def _words(texts: pa.Array, dim: int, first_digit: int, seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every word of a batch; each word is hashed once, and long ones once as long as ``seen`` is kept."""
    if len(seen) >= SEEN_WORDS:
        seen.clear()
    row, words = _split(texts)
    coded = words.dictionary_encode()
    vocabulary = coded.dictionary

    def number(word: str) -> int:
        if word in seen:
            return seen[word]
        digest = hashlib.md5(word.encode()).hexdigest()
        found = int(digest[first_digit : first_digit + 8], 16) % dim
        if len(seen) < SEEN_WORDS:
            seen[word] = found
        return found

    long = pc.binary_length(vocabulary).to_numpy(zero_copy_only=False) > _ONE_BLOCK
    bucket = np.zeros(len(vocabulary), dtype=np.int64)
    bucket[~long] = _digits(_md5(vocabulary.filter(pa.array(~long))), first_digit) % dim
    bucket[long] = [number(w) for w in vocabulary.filter(pa.array(long)).to_pylist()]
    return row, bucket[coded.indices.to_numpy(zero_copy_only=False)]


@dataclass(frozen=True)
class HashModel:
    """Word hashing: each lower-cased ASCII word counts in bucket ``md5 mod dim``.

    ``first_digit`` picks the eight digest digits used, so that two models
    disagree. A text that holds the string ``refuse`` fails, as texts do that a
    model rejects for what they say; no text is cut or dropped for its length.
    """

    name: str
    dim: int
    first_digit: int = 0
    refuse: str | None = None

    def column(self, text: Column) -> Column:
        """``struct<embedding, error>``."""
        dim, first_digit, refuse = self.dim, self.first_digit, self.refuse

        @F.arrow_udf(EMBEDDED)
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            seen: dict[str, int] = {}

            def vectors(texts: pa.Array) -> pa.StructArray:
                row, bucket = _words(texts, dim, first_digit, seen)
                counts = np.bincount(row * dim + bucket, minlength=len(texts) * dim).reshape(len(texts), dim)
                words = counts.sum(axis=1)
                empty = words == 0
                refused = np.zeros(len(texts), dtype=bool)
                if refuse is not None:
                    refused = pc.fill_null(pc.match_substring(texts, refuse), False).to_numpy(zero_copy_only=False)
                length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                rows = (counts / np.where(length == 0, 1, length)).astype(np.float32)
                error = np.where(refused, "refused text", np.where(empty, "no words", None))
                return pa.StructArray.from_arrays(
                    [_vectors(rows, empty | refused, pa.float32()), pa.array(error.tolist(), type=pa.string())],
                    names=["embedding", "error"],
                )

            for texts in batches:
                yield _in_slices(texts, max(1, CELLS // dim), vectors)
                del texts  # else it stays while the next batch is read
                _release()

        return embed.asNondeterministic()(text)


def _slices(texts: pa.Array, rows: int) -> Iterator[slice]:
    """Runs of at most ``rows`` texts and about ``SLICE_BYTES``; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(before, before[start] + SLICE_BYTES, side="right")) - 1
        end = min(len(texts), start + rows, max(start + 1, end))
        yield slice(start, end)
        start = end


def _in_slices(texts: pa.Array, rows: int, vectors: Callable[[pa.Array], pa.StructArray]) -> pa.StructArray:
    """``vectors`` of a run of texts at a time, so that neither long vectors nor long texts fill the memory of a worker."""
    parts = [vectors(texts[part]) for part in _slices(texts, rows)]
    return pa.concat_arrays(parts) if parts else vectors(texts)


@dataclass(frozen=True)
class LoadedModel:
    """Any other model: ``load()`` gives a function from texts to vectors, which gets at most ``batch`` texts at once."""

    name: str
    dim: int
    load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]
    batch: int = 256

    def column(self, text: Column) -> Column:
        dim, load, batch = self.dim, self.load, max(1, self.batch)

        @F.arrow_udf(EMBEDDED)
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = load()

            def one(text: str | None) -> tuple[Sequence[float] | None, str | None]:
                try:
                    return model([text])[0], None
                except Exception as e:
                    return None, str(e) or type(e).__name__

            def vectors(column: pa.Array) -> pa.StructArray:
                texts = column.to_pylist()
                try:
                    found = [(v, None) for v in model(texts)]
                except Exception:
                    # One bad text fails the call: find it, keep the others.
                    found = [one(t) for t in texts]
                if any(v is not None and len(v) != dim for v, _ in found):
                    raise ValueError(f"dimension mismatch: the model must give vectors of {dim}")
                missing = np.array([v is None for v, _ in found], dtype=bool)
                rows = np.zeros((len(found), dim), dtype=np.float32)
                for i, (v, _) in enumerate(found):
                    if v is not None:
                        rows[i] = v
                return pa.StructArray.from_arrays(
                    [_vectors(rows, missing, pa.float32()), pa.array([e for _, e in found], type=pa.string())],
                    names=["embedding", "error"],
                )

            for column in batches:
                yield _in_slices(column, batch, vectors)

        return embed.asNondeterministic()(text)


Model = HashModel | LoadedModel


def embed(df: DataFrame, text: str, model: Model) -> DataFrame:
    """Add ``model``, ``dim``, ``embedding`` and ``error``; a narrow step."""
    return (
        df.withColumn("_e", model.column(F.col(text)))
        .withColumn("model", F.lit(model.name))
        .withColumn("dim", F.lit(model.dim))
        .withColumn("embedding", F.col("_e.embedding"))
        .withColumn("error", F.col("_e.error"))
        .drop("_e")
    )


def embedded_ok(embedded: DataFrame) -> DataFrame:
    return embedded.where(F.col("embedding").isNotNull())


def failed_files(embedded: DataFrame) -> DataFrame:
    return embedded.where(F.col("embedding").isNull()).select("repo_id", "model", "path", "error")


def count_columns() -> list[Column]:
    return [
        F.count("*").alias("files_found"),
        F.count("embedding").alias("files_indexed"),
        F.count_if(F.col("embedding").isNull()).alias("files_failed"),
    ]


def run_counts(embedded: DataFrame) -> DataFrame:
    """Files found, indexed and failed per repository and model."""
    return embedded.groupBy("repo_id", "model").agg(*count_columns())


def embed_two_models(files: DataFrame, text: str, first: Model, second: Model) -> DataFrame:
    """Files both models could embed, with both vectors.

    The vectors of a file are made side by side in one pass, which is the inner
    join of the two results without its shuffle.
    """
    return (
        files.withColumn("_a", first.column(F.col(text)))
        .withColumn("_b", second.column(F.col(text)))
        .withColumn("embedding_1", F.col("_a.embedding"))
        .withColumn("embedding_2", F.col("_b.embedding"))
        .drop("_a", "_b")
        .where(F.col("embedding_1").isNotNull() & F.col("embedding_2").isNotNull())
    )


def sum_counts(texts: DataFrame, text: str, group: str, model: HashModel) -> DataFrame:
    """Embedding of all texts of a group joined by blanks, without joining them.

    Word counts add up: each batch is summed where it is read, and at most
    ``dim`` numbers per group and task are shuffled, so a group may be of any size.
    """
    dim, first_digit = model.dim, model.first_digit

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            groups = batch.column(group).dictionary_encode()
            codes = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for part in _slices(batch.column(text), batch.num_rows):
                row, bucket = _words(batch.column(text)[part], dim, first_digit, seen)
                cell, n = np.unique(codes[part][row] * dim + bucket, return_counts=True)
                names = groups.dictionary.take(pa.array(cell // dim))
                yield pa.RecordBatch.from_arrays([names, pa.array(cell % dim), pa.array(n)], names=[group, "bucket", "n"])
            del batch, groups  # else they stay while the next batch is read
            _release()

    kind = texts.schema[group].dataType.simpleString()
    summed = (
        texts.where(F.col(group).isNotNull())
        .select(group, text)
        .mapInArrow(task, f"{group} {kind}, bucket long, n long")
        .groupBy(group, "bucket")
        .agg(F.sum("n").alias("n"))
    )
    # ``dim`` rows per group at most from here on.
    sparse = summed.groupBy(group).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("c"),
        F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"),
    )
    bucket = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
    vector = F.transform(bucket, lambda b: (F.coalesce(F.col("c")[b], F.lit(0)) / F.col("length")).cast("float"))
    return sparse.select(group, vector.alias("embedding"))
