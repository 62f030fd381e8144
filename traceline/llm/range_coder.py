"""Adaptive context-mixing range coder for token ids, many blocks in step.

Ids are cut into blocks that start from nothing, so each can be read alone. In
a block, tables over the last id (order 1) and the last two (order 2) predict
the next one; how often such predictions have come true, by the confidence of
either table and by the latest outcomes (order 0), gives three probabilities
that are mixed in the logistic domain with weights that learn. An arithmetic
decision codes the prediction's outcome; after a miss follow the id's magnitude
under an adaptive order-0 distribution and the bits below it.

Blocks are coded side by side: each step handles one id of every block with
array operations. Predictions and what a context says follow every id; weights
and magnitudes are learned from several ids at once, after fixed numbers of
ids. Floats hold whole numbers below 2**53 or quotients that every machine
rounds alike, so any machine decodes alike.

File format of a frame, little-endian: ``TLID``, version (u16), 0 (u16), ids of
the longest block (u32), blocks (u32); per block ids (u32; as many or one less),
words (u32), CRC-32 of its ids as unsigned 32-bit integers (u32); then the
blocks' words (u16).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024  # ids
LANES = 6144  # blocks coded side by side; their tables should stay near the processor
SLOT_BITS = 9  # contexts per order
CLASSES = 19  # magnitudes: ids below 2**18
EVERY = 128  # ids after which is learned, and more often at the start
_VERSION = 2
_HEADER = "<4sHHII"
_HEADER_SIZE = struct.calcsize(_HEADER)
_TOP, _LOW, _WORD = 2.0**48, 2.0**32, 2.0**16
_UNITS = 256  # of a distribution of magnitudes
_HIT = CLASSES  # the class of a hit: the whole distribution, no bits below
_ROOM = 20  # places per lane for classes
_CONTEXTS = 16  # per table and lane
_ONE, _THREE, _SIX, _SEVEN, _EIGHT, _FIFTEEN = (np.uint32(n) for n in (1, 3, 6, 7, 8, 15))
_SHIFT, _SHIFT_3, _LINE = np.uint32(32 - SLOT_BITS), np.uint32(29), np.uint32((1 << SLOT_BITS) - 8)
_MIX, _MIX_ONE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _squashed() -> np.ndarray:
    """1 / (1 + e^-x) in 1/4096, for x in 1/64 from -8 to 8; a miss is left 1/64."""
    return np.array([round(4096 / (1 + 2.718281828459045 ** (-x / 64))) for x in range(-_MOST, _MOST + 1)]).clip(1, 4032).astype(np.int32)


_MOST = 511
_SQUASH = _squashed()
_LEAD = np.array([0] + [1 << c for c in range(CLASSES - 1)] + [0], np.float64)
_SHRINK = 1 / np.maximum(_LEAD, 1)
# What the tables say at first, in 1/1024: by history and by confidence, when the tables differ and when they agree.
_SURELY = [-2400, -1200, -400, 0, 300, 500, 700, 900, -2400, -400, 300, 700, 1000, 1200, 1400, 1600]
_FIRST = np.array([[0] * _CONTEXTS, _SURELY, _SURELY], np.int32)


class Model:
    """The adaptive state of every block (lane)."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.slots = np.arange(lanes, dtype=np.uint32) << np.uint32(SLOT_BITS + 1)
        self.table = np.zeros(lanes << (SLOT_BITS + 1), np.uint32)  # id above, confidence in 3 bits below
        self.last = np.zeros((2, lanes), np.uint32)  # hashes of the last ids
        self.rows = np.arange(3 * lanes, dtype=np.uint32).reshape(3, -1) * np.uint32(_CONTEXTS)
        self.history = np.zeros(lanes, np.uint32)
        self.said = np.concatenate([np.tile(first, lanes) for first in _FIRST])
        self.weights = np.full((3, lanes), 1 << 8, np.int32)
        self.gains = np.zeros((3, lanes), np.int32)
        self.classes = np.arange(lanes) * _ROOM
        self.met = np.ones((lanes, _ROOM), np.int32)
        self.kinds = np.zeros((EVERY, lanes), np.int64)
        self.steps = self.note = 0
        self._share_out()

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Predicted id and the probability that it is right, in whole 1/4096."""
        # Eight contexts of order 1 and eight of order 2 that end in the same ids lie side by side.
        one, two = self.last
        both = np.empty((2, self.lanes), np.uint32)
        first, second = both
        np.right_shift(one, _SHIFT, out=first)
        line = first & _LINE
        line += self.slots
        first += line
        np.multiply(two, _MIX, out=second)
        second += one
        second >>= _SHIFT_3
        line += line
        line -= self.slots
        second += line
        second += _EIGHT
        self.at = both.astype(np.int64)
        self.found = self.table.take(self.at)
        self.sure = self.found & _SEVEN
        first, second = self.found
        differ = first ^ second
        same = (differ < _EIGHT).astype(np.uint32)
        same <<= _THREE
        places = self.rows.copy()
        places[0] += self.history
        places[1:] += same
        places[1:] += self.sure
        self.places = places.astype(np.int64)
        differ *= (self.sure[1] < self.sure[0]).astype(np.uint32)
        differ ^= second
        guess = differ >> _THREE
        self.parts = self.said.take(self.places)
        weighted = self.parts * self.weights
        mixed = weighted[0]
        mixed += weighted[1]
        mixed += weighted[2]
        mixed >>= 12
        np.maximum(mixed, -_MOST, out=mixed)
        np.minimum(mixed, _MOST, out=mixed)
        mixed += _MOST
        self.chance = _SQUASH.take(mixed)
        return guess, self.chance

    def update(self, ids: np.ndarray, hit: np.ndarray, place: np.ndarray) -> None:
        """Learn the next ids, whether they were predicted (1 or 0) and the places of their classes."""
        self.kinds[self.note] = place
        self.history <<= _ONE
        self.history += hit
        self.history &= _FIFTEEN
        error = hit.astype(np.int32)
        error <<= 12
        error -= self.chance
        error >>= 4
        if not self.steps & 3:
            self.gains += self.parts * error >> 10
        self.parts += error
        self.said[self.places] = self.parts
        fresh = ids << _THREE
        fresh += _ONE
        self.found >>= _THREE
        entry = (self.found == ids).astype(np.uint32)
        np.minimum(self.sure, _SIX, out=self.sure)
        entry *= self.sure
        entry += fresh
        self.table[self.at] = entry
        self.last[1] = self.last[0]
        fresh *= _MIX_ONE
        self.last[0] = fresh
        self.steps += 1
        self.note += 1
        if self.steps in (8, 16, 32, 64) or self.steps % EVERY == 0:
            self._learn()

    def _learn(self) -> None:
        """Weights and magnitudes learn from the last ids."""
        self.weights += np.clip(self.gains >> 4, -64, 64)
        np.clip(self.weights, 1 << 6, 1 << 10, out=self.weights)
        self.gains[:] = 0
        self.met += np.bincount(self.kinds[: self.note].ravel(), minlength=self.met.size).astype(np.int32).reshape(self.met.shape)
        self.note = 0
        self._share_out()

    def _share_out(self) -> None:
        """Deal the units of every lane's distribution to the magnitudes met, one at least."""
        met = self.met[:, :CLASSES].astype(np.float64)
        sizes = np.floor(met * (_UNITS - CLASSES) / met.sum(1, keepdims=True)) + 1
        sizes[np.arange(self.lanes), sizes.argmax(1)] += _UNITS - sizes.sum(1)
        self.sizes = sizes.astype(np.int32)
        ends = self.sizes.cumsum(1, dtype=np.int32)
        shares = np.full((self.lanes, _ROOM), _UNITS << 8, np.int32)
        shares[:, :CLASSES] = (self.sizes << 8) + ends - self.sizes
        #: The units of a class above the units before it.
        self.shares, self.units = shares.ravel(), None

    def unit_classes(self) -> np.ndarray:
        """The class of every unit of every lane's distribution."""
        if self.units is None:
            every = np.tile(np.arange(CLASSES, dtype=np.uint8), self.lanes)
            self.units = np.repeat(every, self.sizes.ravel())
        return self.units


def _narrowed(width: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Where a hit ends."""
    bound = width * (1 / 4096)
    np.floor(bound, out=bound)
    bound *= chance.astype(np.float64)
    return bound


def _tiled(grid: np.ndarray) -> np.ndarray:
    """Rows as columns."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for a in range(0, grid.shape[0], 64):
        for b in range(0, grid.shape[1], 64):
            out[b : b + 64, a : a + 64] = grid[a : a + 64, b : b + 64].T
    return out


def _encode_lanes(steps: np.ndarray) -> list[bytes]:
    """The words of each column of ids."""
    count, lanes = steps.shape
    model, room = Model(lanes), count + 64
    low, width = np.zeros(lanes), np.full(lanes, _TOP)
    # A carry stays above the 16 bits of the next word until the end.
    out, at = np.zeros(lanes * room, np.int32), np.arange(lanes) * room
    starts = at.copy()
    for t in range(count):
        if t % 16 == 0 and int((at - starts).max()) + 64 > room:
            wider = np.zeros((lanes, room + room // 2), np.int32)
            wider[:, :room] = out.reshape(lanes, room)
            at -= starts
            out, room = wider.ravel(), wider.shape[1]
            starts = np.arange(lanes) * room
            at += starts
        now = steps[t]
        guess, chance = model.predict()
        hit = guess == now
        miss = (~hit).astype(np.float64)
        hit = hit.astype(np.uint32)
        kind = now.astype(np.float32).view(np.int32) >> 23  # the exponent
        kind -= 126
        np.maximum(kind, hit.view(np.int32) << 8, out=kind)
        np.minimum(kind, _HIT, out=kind)
        kind = kind.astype(np.int64)
        place = model.classes + kind
        bound = _narrowed(width, chance)
        low += bound * miss
        width *= miss
        width -= bound
        np.abs(width, out=width)
        width *= 1 / _UNITS
        np.floor(width, out=width)
        share = model.shares.take(place)
        low += width * (share & 255).astype(np.float64)
        share >>= 8
        width *= share.astype(np.float64)
        width *= _SHRINK.take(kind)
        np.floor(width, out=width)
        rest = now.astype(np.float64)
        rest -= _LEAD.take(kind)
        rest *= miss
        rest *= width
        low += rest
        # Every lane writes its next word, and goes on behind it if its range is small.
        small = width < _LOW
        high = low * (1 / _LOW)
        np.floor(high, out=high)
        out[at] = high.astype(np.int32)
        at += small.astype(np.int64)
        small = small.astype(np.float64)
        high *= _LOW
        high *= small
        low -= high
        small *= _WORD - 1
        small += 1
        low *= small
        width *= small
        again = np.flatnonzero(width < _LOW)
        while len(again):
            _word(again, low, out, at)
            width[again] *= _WORD
            again = again[width[again] < _LOW]
        model.update(now, hit, place)
    for _ in range(3):
        _word(np.arange(lanes), low, out, at)
    grid = out.reshape(lanes, room)[:, : int((at - starts).max())]
    carried = np.arange(lanes)
    while len(carried):
        some = grid[carried]
        carry = some >> 16
        some &= 0xFFFF
        some[:, :-1] += carry[:, 1:]
        grid[carried] = some
        carried = carried[(some >> 16).any(1)]
    words = grid.astype("<u2")
    return [row[:n].tobytes() for row, n in zip(words, (at - starts).tolist())]


def _word(lanes: np.ndarray, low: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
    """The next word of some lanes."""
    part = low[lanes]
    high = np.floor(part * (1 / _LOW))
    out[at[lanes]] = high
    at[lanes] += 1
    low[lanes] = (part - high * _LOW) * _WORD


def _decode_lanes(count: int, body: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Columns of ``count`` ids from the words of each."""
    lanes = len(words)
    model = Model(lanes)
    code = np.append(body, np.uint16(0))
    at = np.cumsum(words) - words
    value = np.zeros(lanes)
    for _ in range(3):
        value = value * _WORD + code.take(at)
        at += 1
    width, out = np.full(lanes, _TOP), np.zeros((count, lanes), np.uint32)
    units = np.arange(lanes) * _UNITS
    for t in range(count):
        guess, chance = model.predict()
        bound = _narrowed(width, chance)
        hit = value < bound
        miss = (~hit).astype(np.float64)
        value -= bound * miss
        width *= miss
        width -= bound
        np.abs(width, out=width)
        width *= 1 / _UNITS
        np.floor(width, out=width)
        unit = value / width
        np.minimum(unit, _UNITS - 1, out=unit)
        unit = unit.astype(np.int64)
        unit += units
        kind = model.unit_classes().take(unit)
        np.maximum(kind, hit.view(np.uint8) * np.uint8(_HIT), out=kind)
        kind = kind.astype(np.int64)
        place = model.classes + kind
        share = model.shares.take(place)
        value -= width * (share & 255).astype(np.float64)
        share >>= 8
        width *= share.astype(np.float64)
        width *= _SHRINK.take(kind)
        np.floor(width, out=width)
        rest = value / width
        np.floor(rest, out=rest)
        value -= width * rest
        rest += _LEAD.take(kind)
        hit = hit.astype(np.uint32)
        now = rest.astype(np.uint32)
        guess *= hit
        now += guess
        out[t] = now
        # Every lane looks at its next word, and takes it in if its range is small.
        small = width < _LOW
        part = code.take(at, mode="clip")
        at += small.astype(np.int64)
        part = part.astype(np.float64)
        small = small.astype(np.float64)
        part *= small
        small *= _WORD - 1
        small += 1
        width *= small
        value *= small
        value += part
        again = np.flatnonzero(width < _LOW)
        while len(again):
            value[again] = value[again] * _WORD + code.take(at[again], mode="clip")
            at[again] += 1
            width[again] *= _WORD
            again = again[width[again] < _LOW]
        np.minimum(value, width - 1, out=value)  # of use for damaged words only
        model.update(now, hit, place)
    return out


def _groups(lanes: int) -> list[tuple[int, int]]:
    """Even ranges of blocks that are coded side by side."""
    groups = -(-lanes // LANES)
    cuts = [i * lanes // groups for i in range(groups)] + [lanes]
    return list(zip(cuts, cuts[1:]))


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One frame of ids below ``2**18`` in blocks of about one length, ``block`` at most; no ids give a frame without blocks."""
    ids = ids.astype(np.uint32)
    if len(ids) and int(ids.max()) >> (CLASSES - 1):
        raise ValueError(f"ids must be below 2**{CLASSES - 1}")
    lanes = -(-len(ids) // block)
    count = -(-len(ids) // lanes) if lanes else 0
    long = len(ids) - lanes * (count - 1)
    counts = np.full(lanes, count)
    counts[long:] -= 1
    # A shorter block is coded with one id 0 behind it.
    filled = np.zeros((lanes, count), np.uint32)
    filled[:long] = ids[: long * count].reshape(long, count)
    filled[long:, : count - 1] = ids[long * count :].reshape(lanes - long, max(count - 1, 0))
    bodies: list[bytes] = []
    for first, until in _groups(lanes):
        bodies += _encode_lanes(_tiled(filled[first:until]))
    table = [struct.pack("<III", n, len(body) // 2, zlib.crc32(row[:n].astype("<u4").tobytes())) for n, body, row in zip(counts.tolist(), bodies, filled)]
    return b"".join([struct.pack(_HEADER, b"TLID", _VERSION, 0, count, lanes), *table, *bodies])


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; a damaged frame raises ``ValueError``."""
    if len(frame) < _HEADER_SIZE:
        raise ValueError("not a frame of ids")
    mark, version, _, count, lanes = struct.unpack_from(_HEADER, frame)
    if mark != b"TLID" or version != _VERSION:
        raise ValueError("not a frame of ids")
    if len(frame) < _HEADER_SIZE + 12 * lanes or len(frame) % 2:
        raise ValueError("a frame of ids is cut off or damaged")
    table = np.frombuffer(frame, "<u4", 3 * lanes, _HEADER_SIZE).reshape(lanes, 3).astype(np.int64)
    counts, words, checks = table.T if lanes else (np.zeros(0, np.int64),) * 3
    body = np.frombuffer(frame[_HEADER_SIZE + 12 * lanes :], "<u2")
    if len(body) != words.sum() or (words < 3).any() or ((counts != count) & (counts != count - 1)).any() or (counts < 1).any():
        raise ValueError("a frame of ids is cut off or damaged")
    starts = np.concatenate([[0], np.cumsum(words)])
    parts: list[np.ndarray] = []
    for first, until in _groups(lanes):
        ids = _decode_lanes(count, body[starts[first] : starts[until]], words[first:until])
        parts += [row[:n] for row, n in zip(_tiled(ids), counts[first:until].tolist())]
    for i, (part, check) in enumerate(zip(parts, checks)):
        if zlib.crc32(part.astype("<u4").tobytes()) != check:
            raise ValueError(f"block {i} of a frame of ids is damaged")
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
