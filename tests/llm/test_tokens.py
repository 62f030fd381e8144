import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from traceline.llm import bpe, packing, range_coder, texts, token_files, tokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    "",
    "   ",
    "a" * 3000,
    "ab" * 999,
    "\n \n b  c\t\td",
    "x\u3000 \u3000b\x1c\x85c",
    "don't I'll 12٣ ΣΑΣ İstanbul e\u0301",
    "<|endoftext|> a<|endoftext|>b",
    "emoji 😀😀 ok",
]


def test_bitmap_queue_encodes_like_the_library():
    ranks = bpe.read_ranks(RANKS)
    mine = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, ids in zip(ODD, mine.encode_batch(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert mine.decode(ids).decode() == text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_pieces_encode_like_the_library(name):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    for text, ids in zip(ODD, tokens.FileTokenizer(path).encode_batch(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_round_trip_rows(odd, spark):
    got = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == 10
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (2, 3)] == [(0, empty, empty)] * 2
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    encoded = bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.data).decode()) for r in back) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert bpe.round_trip(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing_places_every_id_once(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(packing.cut_documents(odd, path)).collect()
    whole = Tokenizer.from_file(path)
    want = sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(r.length for r in packed) == want
    places = {}
    for r in packed:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length <= 4 * 2048
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(places) == list(range(len(places)))
    for members in places.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    rows = packing.sequences(packing.pack(packing.cut_documents(odd, path))).collect()
    assert all(len(r.ids) == 4 * packing.padded_length(r.n_tokens) for r in rows)
    assert packing.pack(packing.cut_documents(odd.limit(0), path)).count() == 0


def test_column_generation_beats_the_start_and_covers_all():
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 1500, 20_000)
    histogram = Counter((-(-lengths // 8)).tolist())
    rows = packing.plan_sequences(histogram)
    for kind, count in histogram.items():
        spans = sorted((r[1], r[2]) for r in rows if r[0] == kind)
        assert spans[0][0] == 0 and spans[-1][1] == count
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    sequences = max(r[5] + (r[2] - r[1]) // r[3] for r in rows)
    assert lengths.sum() / 2048 / sequences > 0.98


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17, 1000])
@pytest.mark.parametrize("most", [0, 1, 50_000, 2**18 - 1])
def test_range_coder_round_trip(size, most):
    ids = np.random.default_rng(size + most).integers(0, most + 1, size)
    assert (range_coder.decode(range_coder.encode(ids, 16)) == ids).all()


def test_range_coder_gains_and_notices_damage():
    ids = np.tile(np.arange(40) * 1000, 300)
    frame = range_coder.encode(ids)
    assert len(frame) < len(ids) / 4
    for at in (0, 5, len(frame) // 2):
        damaged = bytearray(frame)
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode(bytes(damaged))
    with pytest.raises(ValueError):
        range_coder.decode(frame[:-2])


def test_blocks_of_a_frame_are_of_one_length(monkeypatch):
    monkeypatch.setattr(range_coder, "LANES", 3)
    for size in (1, 7, 16, 17, 100, 1000):
        ids = np.random.default_rng(size).integers(0, 2**18, size)
        frame = range_coder.encode(ids, 16)
        blocks = -(-size // 16)
        counts = np.frombuffer(frame, "<u4", 3 * blocks, 16).reshape(-1, 3)[:, 0]
        assert counts.sum() == size and counts.max() - counts.min() <= 1
        assert (range_coder.decode(frame) == ids).all()


def test_the_surer_order_predicts():
    # Ids that follow each other always, in pairs that come in any order, which order 2 learns later than order 1.
    pairs = np.random.default_rng(5).permutation(np.repeat(np.arange(30), 400))
    ids = np.stack([pairs * 997, pairs * 997 + 7], 1).ravel()
    frame = range_coder.encode(ids)
    assert (range_coder.decode(frame) == ids).all()
    assert len(frame) < 1.06 * len(ids)


def test_token_files_without_ids(spark, tmp_path):
    docs = spark.createDataFrame([(i, "one two three " * i) for i in range(5)], "doc_id long, text string")
    token_files.write_token_files(docs, f"{tmp_path}/files", public_tokenizers.path("word_bpe_49k.json"))
    whole = token_files.read_token_files(spark, f"{tmp_path}/files")
    bare = token_files.read_token_files(spark, f"{tmp_path}/files", with_ids=False)
    assert sorted(bare.collect()) == sorted(whole.drop("ids").collect())


def test_words_of_letters_and_marks_are_looked_up_without_case_and_marks():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, whole = tokens.FileTokenizer(path), Tokenizer.from_file(path)
    chars = [*"aAbzZàÀÖØßÿÞ×÷ªµºſİ日😀''.,;<|>&~^_019 \n\t\r\v\f\x85\xa0", "é", "'s", "'LL"]
    draw = np.random.default_rng(4)
    said = ["".join(draw.choice(chars, n)) for n in draw.integers(0, 40, 2000)] + ["x" * 70 + "!", "!" * 70]
    for _ in range(2):
        for text, ids in zip(said, coder.encode_batch(said)):
            assert list(np.frombuffer(ids, "<u4")) == whole.encode(text, add_special_tokens=False).ids, text
    column = pa.array([None, "", None, "<|endoftext|>\nx", *said, None, "a\nb", "<|ENDOFTEXT|>"])
    for part in (column, column.slice(4), column.slice(3, 1), column.slice(0, 3), column.slice(9, 0), pa.array([None, ""], pa.string())):
        assert coder.encode_column(part) == coder.encode_batch(texts.strings(part))
    coder = tokens.FileTokenizer(path)
    coder.encode_batch(["Word, word WORD.\nword...\tÉté été!"])
    assert coder.known.words.to_pylist() == ["word", "été"] and not coder.memo.young


def test_word_table_begins_anew_when_it_is_full():
    asked = []
    table = texts.WordTable(lambda words: asked.append(words) or [[len(w), 7] for w in words], 4)
    for words in (["a", "bb", "ccc"], ["bb", "a"], ["ccc", "dddd", "eeeee"], [], ["a", "ccc"]):
        values = table.of(pa.array(words, pa.large_string()))
        assert [np.frombuffer(v, "<u4").tolist() for v in values.to_pylist()] == [[len(w), 7] for w in words]
        assert len(table.words) <= 4
    assert asked == [["a", "bb", "ccc"], ["dddd", "eeeee"], ["a"]]


def test_token_files_give_back_every_document(odd, spark, tmp_path):
    name = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(odd, f"{tmp_path}/files", name, frame=5000)
    got = token_files.read_token_files(spark, f"{tmp_path}/files").orderBy("start").collect()
    whole, start = Tokenizer.from_file(name), 0
    rows = sorted(odd.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    assert len(got) == len(rows)
    for r, want in zip(got, rows):
        ids = np.array(whole.encode(want.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(r.ids) == ids.tobytes()
        start += len(ids)


def test_texts_are_sliced_by_their_bytes():
    rows = ["ab"] * 2000 + [None, "x" * 90, "é" * 30, "y" * 500, "", "z"]
    batch = pa.record_batch([pa.array(range(len(rows))), pa.array(rows)], names=["doc_id", "text"])
    parts = [part.column(1).to_pylist() for part in texts.text_slices([batch, batch.slice(0, 0)], 1, 100)]
    assert [text for part in parts for text in part] == rows
    assert all(len(part) == 1 or sum(len((text or "").encode()) for text in part) <= 100 for part in parts)
    assert len(parts) == 44
    # Short rows share a slice, whatever their number, so a word they share is looked up once.
    assert [part.num_rows for part in texts.text_slices([batch], 1)] == [len(rows)]
