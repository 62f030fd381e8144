"""Ids of tokenizer files, with what was worked out kept per word."""

from __future__ import annotations

import os
import re
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from traceline.llm.texts import Memo, WordTable, cut_at_spaces, has_two_blanks, joined_values, joined_words

# Latin texts without rare blanks or combining marks: there the steps before
# the merges are the patterns below; anything else takes the library's whole path.
_PLAIN = re.compile("[\n\t\r\x20-\x7e¡-ɏ]*")

# The patterns of the two tokenizer files.
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Letters that are one character in lower case, too, and marks that neither begin nor join a word. A word of
# letters and then marks is two tokens' texts.
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_LETTERS_THEN_MARKS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*[!-&(-/:-@\\[-`{-~]*$"

_BLANKS = bytes.maketrans(b"\n\t\r", b"   ")
_LONGEST = 64  # bytes of a word that is looked up in the table


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


def _packed(ids: list[int]) -> bytes:
    return pack(_FORMATS[len(ids)], *ids) if len(ids) < 64 else pack(f"<{len(ids)}I", *ids)


_FORMATS = [f"<{n}I" for n in range(64)]


class FileTokenizer:
    """A tokenizer file of the byte-level or the word-end kind.

    Gives what ``Tokenizer.encode(text, add_special_tokens=False)`` gives. A
    text is cut where no token can cross, and each piece is encoded once while
    it is remembered.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.words = self.whole.normalizer is not None
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.split = regex.compile(_WORD_PATTERN if self.words else _BYTE_PATTERN).findall
        self.alphabet = _byte_alphabet()
        self.parts = Memo(self._parts, 1_000_000)
        self.memo = Memo(self._pieces, 1_200_000)
        self.known = WordTable(self._ids, 500_000)

    def _split(self, piece: str) -> list[str]:
        """The pattern's matches, found without it for a word and a word with a mark."""
        start = piece[:1] == " "
        if piece[start:].isalpha():
            return [piece]
        if piece[-1:] in ".,!?;:|" and piece[start:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.split(piece)

    def _parts(self, parts: list[str]) -> list[bytes]:
        return [_packed(ids) for ids in self._ids(parts)]

    def _full(self, text: str) -> bytes:
        return _packed(self.whole.encode(text, add_special_tokens=False).ids)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        plain = [bool(_PLAIN.fullmatch(piece)) for piece in pieces]
        split = [self._split(piece.lower() if self.words else piece) for piece, ok in zip(pieces, plain) if ok]
        ids = iter(self.parts.of(split))
        return [b"".join(next(ids)) if ok else self._full(piece) for piece, ok in zip(pieces, plain)]

    def _ids(self, words: list[str]) -> list[list[int]]:
        model = self.whole.model
        return [[t.id for t in model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))] for word in words]

    def _word_values(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of distinct words, and where each word's are."""
        plain = pc.and_(pc.match_substring_regex(words, _LETTERS_THEN_MARKS), pc.less_equal(pc.binary_length(words), _LONGEST))
        simple = words.filter(plain)
        letters = pc.utf8_lower(pc.utf8_rtrim(simple, _MARKS)).dictionary_encode()
        letters = self.known.of(letters.dictionary).take(letters.indices)
        marks = pc.utf8_ltrim(simple, _LETTERS).dictionary_encode()
        marks = pa.array(self.parts.of([marks.dictionary.to_pylist()])[0], pa.large_binary()).take(marks.indices)
        other = pa.array(self.memo.of([words.filter(pc.invert(plain)).to_pylist()])[0], pa.large_binary())
        values = pa.concat_arrays([pc.binary_join_element_wise(letters, marks, pa.scalar(b"", pa.large_binary())), other])
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        places = np.empty(len(words), np.int64)
        places[order] = np.arange(len(words))
        return values, places

    def _by_words(self, column: pa.Array) -> list[bytes] | None:
        """White space parts words and has no ids, and each distinct word is looked up once. None: a word has a special token."""
        if not len(column):
            return []
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
        first, size = int(ends[0]), int(ends[-1] - ends[0])
        parted = data.slice(first, size).to_pybytes().translate(_BLANKS) if size else b""
        column = pa.Array.from_buffers(column.type, len(column), [None, pa.py_buffer(ends - first), pa.py_buffer(parted)])
        words = pc.split_pattern(column, " ")
        coded = words.flatten().dictionary_encode()
        if any(pc.any(pc.match_substring(coded.dictionary, special)).as_py() for special in self.special):
            return None
        values, places = self._word_values(coded.dictionary)
        return joined_values(values, places[coded.indices.to_numpy(zero_copy_only=False)], words.value_lengths())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        marked = {i: self._full(t) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        spaced = [] if self.words else [i for i, t in enumerate(texts) if i not in marked and has_two_blanks(t)]
        marked |= zip(spaced, (b"".join(parts) for parts in self.memo.of([cut_at_spaces(texts[i]) for i in spaced])))
        plain = [t for i, t in enumerate(texts) if i not in marked]
        rest = iter(self._by_words(pa.array(plain, pa.large_string())) if self.words else joined_words(plain, self.memo, " "))
        return [marked[i] if i in marked else next(rest) for i in range(len(texts))]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """The same of a column; a NULL is an empty text."""
        column = pc.fill_null(texts.cast(pa.large_string()), "")
        found = self._by_words(column) if self.words else None
        return self.encode_batch(column.to_pylist()) if found is None else found


_loaded: dict[str, FileTokenizer] = {}


def tokenizer(path: str) -> FileTokenizer:
    """One tokenizer per worker."""
    if path not in _loaded:
        _loaded[path] = FileTokenizer(path)
    return _loaded[path]
