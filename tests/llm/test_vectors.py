"""Prefix trie, whitening and exact products against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from checks.compare import database, differences
from traceline.llm import exact_topk, prefix_trie, whitening

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, name string, parent string, at int"
VECTORS = "vec_id long, embedding array<float>, x int, at string, score string, qn int, component int"


def talks(spark, rows):
    return spark.createDataFrame([(*r, 7, "n", "p", 1) for r in rows], CONVERSATIONS)


def vectors(spark, rows):
    floats = [(i, v if v is None else [c if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 1, "a", "s", 2, 3) for i, v in floats], VECTORS)


def brute_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = f"{len(role or '')}:{role or ''}{text or ''}".encode()
            by[c].append((turn is not None, turn or 0, hashlib.sha256(key).digest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in by.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def totals(node):
        below = [totals(c) for c in children[node]]
        own_tokens = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        return sum(b[0] for b in below) or (not below), own_tokens + sum(b[1] for b in below)

    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        leaves, saved = totals(node)
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), int(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_talks(draw, n):
    rows = []
    for c in draw.sample(range(350), n):
        for turn in range(draw.choice([1, 2, 3, 5, 9, 18])):
            rows.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", None, ""])))
    return rows


def test_trie_by_brute_force(spark, rows):
    draw = random.Random(3)
    table = random_talks(draw, 120)
    # Copies of one conversation, one first turn of many, ties, repeated rows, NULL turns and ids, a long conversation.
    table += [(c, t, "user", f"copy {t}") for c in range(400, 440) for t in range(4)]
    table += [(500 + c, 0, "system", "one first turn") for c in range(30)] + [(500 + c, 1, "user", f"own {c}") for c in range(30)]
    table += [(600, 1, "user", "tie"), (600, 1, "user", "other"), (600, None, "user", "first"), (600, 1, "user", "tie")]
    table += [(None, 1, "user", "nobody"), (700, None, None, None)]
    table += [(701, t, "user", "é" * (t % 5)) for t in range(70)]
    got = prefix_trie.conversation_trie(talks(spark, table).repartition(5))
    assert rows(got) == brute_trie(table)


def test_trie_of_little(spark, rows):
    assert rows(prefix_trie.conversation_trie(talks(spark, []))) == []
    assert rows(prefix_trie.conversation_trie(talks(spark, [(None, 1, "user", "x")]))) == []
    # Conversation 2 lacks its base and has no more turns than it would take: it ends at the root.
    alone = [(2, 0, "user", "x")]
    assert zlib.crc32(b"2") % 6 > 0
    assert rows(prefix_trie.conversation_trie(talks(spark, alone))) == brute_trie(alone)


def test_names_do_not_depend_on_the_conversation(spark):
    turns = talks(spark, [(c, t, "user", "same") for c in (1, 2) for t in range(9)] + [(1, 9, "user", "end")])
    ordered = prefix_trie.ordered_turns(turns).withColumnRenamed("place", "depth")
    prefixes, levels = prefix_trie.name_prefixes(ordered)
    found = prefixes.collect()
    assert levels == 4 and len(found) == 19
    names = {(r.conv_id, r.depth): bytes(r.name) for r in found}
    assert all(names[1, d] == names[2, d] for d in range(1, 10)) and len(set(names.values())) == 10
    assert all(bytes(r.parent) == names.get((r.conv_id, r.depth - 1), b"") for r in found)


def brute_whitened(rows, components=4, scale=256):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in kept)
    x = {tuple(int(np.floor(scale * float(np.float32(c)))) for c in v) + (0,) * (dim - len(v)) for _, v in kept}
    fit = np.array(sorted(x), dtype=np.float64)
    n, sums = len(fit), [sum(int(c) for c in col) for col in fit.T]
    off = fit - np.array(sums) / n
    values, directions = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-values)[:components]
    out = {}
    for i, v in kept:
        own = tuple(int(np.floor(scale * float(np.float32(c)))) for c in v) + (0,) * (dim - len(v))
        deviation = sum((n * c - s) ** 2 for c, s in zip(own, sums))
        w = (np.array(own) - np.array(sums) / n) @ directions[:, order] / np.sqrt(values[order])
        out[i] = (n, deviation, w, values[order] / values.sum())
    return out


def test_whitening_by_brute_force(spark):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(90, 6)) * [3, 2.5, 1, 0.7, 0.4, 0.2] + [1, 0, 0, 5, 0, 0]
    table = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    table += [(100 + i, table[3][1]) for i in range(60)]  # copies count once
    table += [(200, None), (201, [1.0, None, 0, 0, 0, 0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [0.5, 0.25])]
    want = brute_whitened(table)
    got = defaultdict(dict)
    for r in whitening.whiten(vectors(spark, table).repartition(4)).collect():
        got[r.vec_id][r.component] = r
    assert set(got) == set(want)
    signs = np.sign([got[0][j].whitened * want[0][2][j - 1] for j in (1, 2, 3, 4)])
    for i, (n, deviation, w, explained) in want.items():
        found = [got[i][j] for j in (1, 2, 3, 4)]
        assert {(r.n, r.deviation) for r in found} == {(n, deviation)}
        assert np.allclose([r.whitened for r in found] * signs, w, atol=1e-8)
        assert np.allclose([r.explained for r in found], explained, rtol=1e-9)
        assert all(r.identity_error < 1e-8 for r in found)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    equal = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert equal.count() == 0 and equal.columns[0] == "vec_id"
    line = whitening.whiten(vectors(spark, [(1, [1.0, 0.0]), (None, [2.0, 0.0]), (1, [3.0, 0.0])])).collect()
    assert Counter((r.vec_id, r.component) for r in line) == {(1, 1): 2, (None, 1): 1}
    assert sorted(abs(r.whitened) for r in line) == pytest.approx([0, 1.5**0.5, 1.5**0.5])
    huge = whitening.whiten(vectors(spark, [(1, [1e9, 0.0]), (2, [-1e9, 3.0])])).collect()
    assert {r.deviation for r in huge} == {None}


def brute_products(rows, k=20, scale=64):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in kept if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in kept if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("steep", [0.9, 0.0, 2.0])
def test_products_by_brute_force(spark, rows, steep):
    draw = np.random.default_rng(4)
    size = draw.lognormal(sigma=0.8, size=(240, 1))
    table = [(i, [float(c) for c in v]) for i, v in enumerate(draw.normal(size=(240, 5)) * size)]
    table += [(300 + i, table[40][1]) for i in range(60)]  # copies, some of them queries
    table += [(400 + i, [0.0] * 5) for i in range(25)] + [(500, [4.0, 1.0])]
    table += [(40, table[40][1]), (41, table[41][1]), (None, table[1][1]), (520, None), (540, [None] * 5), (560, [float("nan")] * 5)]
    df = vectors(spark, table).repartition(3)
    found = exact_topk.top_products(df, df.where("vec_id % 20 = 0"), bucket=40, group=7, steep=steep)
    assert rows(found) == brute_products(table)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


def test_products_of_little(spark, rows):
    none = vectors(spark, [])
    assert exact_topk.top_products(none, none).count() == 0
    few = vectors(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])])
    assert rows(exact_topk.top_products(few, few.where("vec_id = 0"))) == [(0, 1, 1, 64 * 128), (0, 2, 2, 64 * 128)]
    large = vectors(spark, [(0, [3e5, 1.0]), (1, [3e5, 2.0])])  # beyond what a float holds exactly
    assert rows(exact_topk.top_products(large, large.where("vec_id = 0"))) == [(0, 1, 1, 19200000**2 + 64 * 128)]
    with pytest.raises(Exception, match="too long"):
        exact_topk.top_products(vectors(spark, [(0, [3e30]), (1, [1.0])]), few).count()


def bucket_tables(ids, x, own, asks, least):
    def norm2(v):
        return pa.array((v**2).sum(axis=1))

    given = pa.table({"vec_id": ids, "x": x.tolist(), "norm2": norm2(x)})
    return given, pa.table({"qn": np.arange(len(asks)), "vec_id": own, "x": asks.tolist(), "norm2": norm2(asks), "least": pa.array(least, pa.float64())})


def test_coordinates_give_what_lengths_give():
    """High thresholds go through the coordinate lists; both ways give the same finds, and bounds leave something out."""
    draw = np.random.default_rng(2)
    x = np.floor(64 * draw.normal(size=(500, 8))).astype(np.int64)
    asks = x[:60] + draw.integers(-3, 4, size=(60, 8))
    least = [float(sorted((x @ q), reverse=True)[4]) for q in asks]
    given, asked = bucket_tables(np.arange(500), x, np.arange(1000, 1060), asks, least)
    one, two = (exact_topk.search_bucket(given, asked, 5, steep=s) for s in (0.0, 5.0))
    assert sorted(map(tuple, zip(*one.to_pydict().values()))) == sorted(map(tuple, zip(*two.to_pydict().values())))
    assert one.num_rows >= 300
    above = [1.01 * np.sqrt((x**2).sum(axis=1).max()) * np.linalg.norm(q) for q in asks]
    assert exact_topk.search_bucket(*bucket_tables(np.arange(500), x, np.arange(60), asks, above), 5).num_rows == 0


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_exact_topk"])
def test_queries_agree_with_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    left = __spark_entry__.queries()[name](spark, sf).toPandas()
    assert differences(left, database(sf).execute(__spark_entry__.oracle_sql()[name]).df()) is None


def test_whitening_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_whitened(given)
    got = __spark_entry__.queries()["op12_whitening"](spark, sf).toPandas()
    assert len(got) == 4 * len(want)
    for r in got.itertuples():
        n, deviation, w, explained = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
        assert abs(r.whitened) == pytest.approx(abs(w[r.component - 1]), abs=1e-7)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
