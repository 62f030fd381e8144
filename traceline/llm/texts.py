"""Text helpers shared by the operators that run Python inside tasks."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS = 1000  # documents handled at once inside an Arrow batch
WORD_ROWS = 5000  # the same where each distinct word of them is looked up once
SLICE_BYTES = 16 * 2**20  # bytes of texts handled at once where rows may be long

_TWO_BLANKS = re.compile(r"\s\s")
_BEFORE_WORD = re.compile(r"(?= \S)")


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_slices(batches: Iterable[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have at most ``size`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(before, before[start] + size, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def strings(column: pa.Array) -> list[str]:
    """The texts of a column; a NULL is an empty text."""
    return [text or "" for text in column.to_pylist()]


def has_two_blanks(text: str) -> bool:
    """Then a cut at every space would part blanks that belong together."""
    return _TWO_BLANKS.search(text) is not None


def cut_at_spaces(text: str) -> list[str]:
    """Cut before each space that a word follows.

    Byte-level pre-tokenizers put such a space in front of the next word, so no
    pre-token crosses a cut, and a run of blanks stays in one piece.
    """
    if has_two_blanks(text):
        return [piece for piece in _BEFORE_WORD.split(text) if piece]
    first, *rest = text.split(" ")
    pieces = [" " + piece for piece in rest]
    return [first, *pieces] if first else pieces


def joined_words(texts: list[str], memo: Memo, lead: str) -> list[bytes]:
    """The values (bytes) of the words of each text, joined.

    Words are what lies between spaces; all but the first of a text are asked
    for with ``lead`` before them. Each distinct word of the batch is looked up
    once, and the texts are put together by place.
    """
    words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = words.flatten().dictionary_encode()
    vocabulary, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = words.value_lengths()
    pieces = vocabulary
    if lead:
        numbers = counts.to_numpy(zero_copy_only=False)
        firsts = np.cumsum(numbers) - numbers
        pieces = [lead + word for word in vocabulary] + [vocabulary[i] for i in index[firsts].tolist()]
        index[firsts] = len(vocabulary) + np.arange(len(texts))
    return joined_values(pa.array(memo.of([pieces])[0], pa.large_binary()), index, counts)


def joined_values(values: pa.Array, index: np.ndarray, counts: pa.Array) -> list[bytes]:
    """``values[index]`` joined, the first of ``counts`` of them, the next and so on."""
    data, ends = taken_bytes(values, index)
    bounds = ends[np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False))])].tolist()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def taken_bytes(values: pa.Array, index: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``values[index]`` as one run of bytes, and where each begins in it, the end included."""
    taken = values.take(pa.array(index))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    return b"" if data is None else data.to_pybytes(), ends


class WordTable:
    """Ids of words, each worked out once while the table has room for it.

    Words and ids are Arrow columns. A table that would grow beyond ``size``
    words begins anew with those asked for last.
    """

    def __init__(self, make: Callable[[list[str]], list[list[int]]], size: int):
        self.make, self.size = make, size
        self.words, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def of(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words as little-endian unsigned 32-bit integers."""
        place = pc.index_in(words, value_set=self.words)
        unknown = words.filter(place.is_null())
        if len(unknown):
            if len(self.words) + len(unknown) > self.size:
                kept = place.drop_null()
                self.words, self.values = self.words.take(kept), self.values.take(kept)
                place = pc.index_in(words, value_set=self.words)
            made = self.make(unknown.to_pylist())
            offsets = np.zeros(len(made) + 1, np.int64)
            np.cumsum([4 * len(ids) for ids in made], out=offsets[1:])
            data = np.fromiter(chain.from_iterable(made), "<u4", int(offsets[-1]) // 4)
            values = pa.Array.from_buffers(pa.large_binary(), len(made), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            fresh = np.arange(len(self.words), len(self.words) + len(made))
            self.words, self.values = pa.concat_arrays([self.words, unknown]), pa.concat_arrays([self.values, values])
            place = pc.replace_with_mask(place, place.is_null(), pa.array(fresh, place.type))
        return self.values.take(place)


class Memo:
    """Values of pieces of text, each worked out once while it is remembered.

    Two generations of at most ``size`` entries bound the memory: when the
    young one is full it becomes the old one, and what is asked for again
    moves back. Pieces over ``longest`` characters are not remembered.
    """

    def __init__(self, make: Callable[[list[str]], list], size: int = 400_000, longest: int = 64):
        self.make, self.size, self.longest = make, size, longest
        # Looking for cycles among millions of remembered strings costs much and finds none.
        gc.set_threshold(500_000, 50, 50)
        self.young: dict = {}
        self.old: dict = {}

    def of(self, texts: list[list[str]]) -> list[list]:
        """The values of the pieces of several texts."""
        asked = set().union(*texts) if texts else set()
        missing = asked - self.young.keys()
        if len(self.young) + len(missing) > self.size:
            self.old, self.young = self.young, {}
            missing = asked
        known = missing & self.old.keys()
        self.young.update((piece, self.old[piece]) for piece in known)
        unknown = list(missing - known)
        made = dict(zip(unknown, self.make(unknown)))
        self.young.update(made)
        get = self.young.__getitem__
        found = [list(map(get, pieces)) for pieces in texts]
        for piece in unknown:
            if len(piece) > self.longest:
                del self.young[piece]
        return found
