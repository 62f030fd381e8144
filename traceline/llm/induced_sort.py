"""Suffix order of a byte string by induced sorting with disk-backed queues.

Suffixes that begin a rise (LMS suffixes) are sorted first; the order of all
others is induced from them. Suffix tuples wait in a monotone priority queue,
one first-in-first-out run per leading byte, whose tail goes to disk beyond a
memory bound: a tuple taken from the queue puts its left neighbour into the
run of that neighbour's byte. The order is exact for the first ``depth`` bytes,
which is all that repeats of that length need; deeper ties stay in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 64 * 2**20  # bytes of waiting tuples kept in memory by one queue


class ByteQueue:
    """Positions in runs by leading byte; a run is read in the order it was written."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.waiting = memory, 0
        self.runs: list[list[np.ndarray | tuple[int, int]]] = [[] for _ in range(257)]
        self.file = None

    def put(self, keys: np.ndarray, positions: np.ndarray) -> None:
        """Append each position to the run of its key, keeping their order."""
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, positions = keys[order], positions[order]
        bounds = np.flatnonzero(np.diff(keys)) + 1
        for key, part in zip(keys[np.append(0, bounds)], np.split(positions, bounds)):
            self.runs[key].append(part)
        self.waiting += positions.nbytes
        if self.waiting > self.memory:
            self._to_disk()

    def _to_disk(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for run in self.runs:
            held = [part for part in run if isinstance(part, np.ndarray)]
            if held:
                whole = np.concatenate(held)
                run[:] = [part for part in run if not isinstance(part, np.ndarray)] + [(self.file.tell(), len(whole))]
                whole.tofile(self.file)
        self.file.flush()
        self.waiting = 0

    def take(self, key: int) -> np.ndarray:
        """All that waits in a run, which is empty afterwards."""
        parts, self.runs[key] = self.runs[key], []
        out = []
        for part in parts:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.fromfile(self.file, np.int32, part[1])
            else:
                self.waiting -= part.nbytes
            out.append(part)
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(text),), (1,))


def _sort_by_words(words: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their first ``depth`` bytes: each round orders what is still tied by eight bytes more."""
    size = len(words)
    rank = np.zeros(len(positions), np.int64)
    order = np.arange(len(positions))
    open_ = order.copy()
    for shift in range(0, depth if len(positions) else 0, 8):
        at = positions[order[open_]].astype(np.int64) + shift
        value = np.where(at < size, words[np.minimum(at, size - 1)].astype(np.uint64), np.uint64(0))
        group = rank[open_]
        sort = np.lexsort((value, group))
        order[open_] = order[open_][sort]
        group, value = group[sort], value[sort]
        new = np.append(True, (group[1:] != group[:-1]) | (value[1:] != value[:-1]))
        rank[open_] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        tied = ~new
        tied[:-1] |= ~new[1:]
        open_ = open_[tied]
        if not len(open_):
            break
    return positions[order]


def suffix_order(text: np.ndarray, depth: int, memory: int = MEMORY) -> np.ndarray:
    """All positions of ``text`` (uint8) in the order of their first ``depth`` bytes."""
    size = len(text)
    if size == 0:
        return np.zeros(0, np.int32)
    # A suffix rises (S) when the first different byte after it is greater.
    following = np.append(text[1:], 0)
    change = np.sign(following.astype(np.int16) - text).astype(np.int8)
    change[-1] = -1  # the end is smaller than any byte
    place = np.where(change != 0, np.arange(size), size)
    rises = change[np.minimum.accumulate(place[::-1])[::-1]] > 0
    begins = np.append(False, rises[1:] & ~rises[:-1])
    sorted_lms = _sort_by_words(words_at(text), np.flatnonzero(begins).astype(np.int32), depth)

    def predecessors(taken: np.ndarray, falling: bool) -> np.ndarray:
        left = taken[taken > 0] - 1
        return left[rises[left] != falling]

    falls = ByteQueue(memory)
    lms = ByteQueue(memory)
    lms.put(text[sorted_lms], sorted_lms)
    if not rises[-1]:
        falls.put(text[-1:], np.array([size - 1], np.int32))
    down: list[np.ndarray] = []
    for key in range(256):
        found = []
        while len(taken := falls.take(key)):
            found.append(taken)
            left = predecessors(taken, True)
            falls.put(text[left], left)
        down.append(np.concatenate(found) if found else np.zeros(0, np.int32))
        left = predecessors(lms.take(key), True)
        falls.put(text[left], left)

    climbs = ByteQueue(memory)  # by descending byte, each run from its largest suffix down
    whole: list[np.ndarray] = []
    for key in range(255, -1, -1):
        found = []
        while len(taken := climbs.take(key)):
            found.append(taken)
            left = predecessors(taken, False)
            climbs.put(text[left], left)
        whole += found
        last = down[key][::-1]
        left = predecessors(last, False)
        climbs.put(text[left], left)
        whole.append(last)
    return np.concatenate(whole)[::-1]


def equal_runs(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """A number per entry of ``order``, the same for neighbours that share ``depth`` bytes.

    Common prefixes are measured eight bytes at a time, only while they last.
    """
    if not len(order):
        return np.zeros(0, np.int64)
    words = words_at(text)
    same = np.arange(1, len(order))
    for shift in [*range(0, depth - 8, 8), depth - 8]:
        one, two = order[same].astype(np.int64) + shift, order[same - 1].astype(np.int64) + shift
        good = np.maximum(one, two) + 8 <= len(text)
        same, one, two = same[good], one[good], two[good]
        same = same[words[one] == words[two]]
    new = np.ones(len(order), bool)
    new[same] = False
    return np.cumsum(new) - 1
