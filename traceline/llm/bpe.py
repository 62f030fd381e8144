"""Byte-level BPE with a rank queue made of bitmaps.

A rank file gives every token its bytes and a rank; the pair of neighbours
whose joined bytes have the least rank is merged first, the leftmost of equal
ones. The queue holds one bucket of positions per rank and a bitmap of two
levels over the buckets, so the least rank is found by two find-first-set
steps whatever the length of the pre-token. Positions are nodes of a linked
list; an entry whose pair has changed meanwhile is stale and skipped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from traceline.llm.texts import WORD_ROWS, Memo, cut_at_spaces, has_two_blanks, joined_words, slices, strings, taken_bytes

_FAN = 8  # a bitmap word stands for 256 buckets; Python integers may be that wide
_LOW = (1 << _FAN) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encode and decode by a table of ranks; ``pattern`` splits a text first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.words = Memo(self._words, 800_000)
        self.memo = Memo(self._pieces)

    def pre_token(self, data: bytes) -> list[int]:
        """The ids of one pre-token.

        The queue is written out in place: ``buckets`` holds the positions of
        a rank as a heap, ``words`` the lower bitmap, ``top`` the upper one.
        """
        rank_of = self.ranks.get
        whole = rank_of(data)
        if whole is not None:
            return [whole]
        size = len(data)
        end = list(range(1, size + 1))  # a node is named by its first byte
        before = list(range(-1, size - 1))
        pair = [rank_of(data[at : at + 2]) for at in range(size - 1)]  # a node joined with the next
        pair.append(None)
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        for at, rank in enumerate(pair):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(at)
                else:
                    buckets[rank] = [at]
                    words[rank >> _FAN] = words.get(rank >> _FAN, 0) | 1 << (rank & _LOW)
        top = 0
        for word in words:
            top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word << _FAN | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                bits &= bits - 1
                words[word] = bits
                if not bits:
                    top &= top - 1
            if pair[at] != rank:
                continue
            gone = end[at]
            stop = end[at] = end[gone]
            pair[gone] = None
            if stop < size:
                before[stop] = at
                right = pair[at] = rank_of(data[at : end[stop]])
            else:
                right = pair[at] = None
            left = before[at]
            if left >= 0:
                joined = rank_of(data[left:stop])
                if joined == pair[left]:
                    joined = None
                else:
                    pair[left] = joined
            else:
                joined = None
            for new, place in ((joined, left), (right, at)):
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], place)
                    else:
                        buckets[new] = [place]
                        word = new >> _FAN
                        words[word] = words.get(word, 0) | 1 << (new & _LOW)
                        top |= 1 << word
        ids, at = [], 0
        while at < size:
            stop = end[at]
            ids.append(self.ranks[data[at:stop]])
            at = stop
        return ids

    def _words(self, words: list[str]) -> list[bytes]:
        return [pack(f"<{len(ids)}I", *ids) for ids in map(self.pre_token, map(str.encode, words))]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return [b"".join(parts) for parts in self.words.of(list(map(self.split, pieces)))]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        spaced = [i for i, text in enumerate(texts) if has_two_blanks(text)]
        found = dict(zip(spaced, (b"".join(parts) for parts in self.memo.of([cut_at_spaces(texts[i]) for i in spaced]))))
        rest = iter(joined_words([text for i, text in enumerate(texts) if i not in found], self.memo, " "))
        return [found[i] if i in found else next(rest) for i in range(len(texts))]

    def decode(self, ids: bytes) -> bytes:
        places = np.frombuffer(ids, "<u4").astype(np.int64)
        data, ends = taken_bytes(self.tokens, places)
        # A token has at least a byte, so what takes none is no token.
        if (np.diff(ends) == 0).any():
            raise KeyError(f"no such token: {int(places[np.diff(ends) == 0][0])}")
        return data


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder per worker, so that what it remembers serves all tasks."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, n_tokens``: the ids of each text as binary unsigned 32-bit integers.

    A NULL text is empty and has no ids. Rows are handled one by one, so keys
    may be NULL or repeat; other columns of ``docs`` are ignored. Narrow.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for part in slices(batches, WORD_ROWS):
            ids = bpe.encode_batch(strings(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                names=[key, "ids", "n_tokens"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(task, f"`{key}` {kind}, ids binary, n_tokens bigint")


def decode_documents(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key, data``: the bytes behind ``ids``; NULL ids decode to no bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for part in slices(batches, WORD_ROWS):
            data = [bpe.decode(ids or b"") for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=[key, "data"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(task, f"`{key}` {kind}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of each text encoded and decoded again.

    Both directions run in one pass, so neither ids nor bytes leave the task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for part in slices(batches, WORD_ROWS):
            ids = bpe.encode_batch(strings(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(task, schema)
