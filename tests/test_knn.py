import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from traceline.operators import approximate, knn
from traceline.operators.approximate import (
    ProbePlan,
    build_buckets,
    choose_plan,
    lines,
    nearest_lsh,
    probe_codes,
    probe_ranks,
    read_buckets,
    search_buckets,
    solve_plan,
)
from traceline.operators.knn import keep_best, nearest, nearest_blocked, rank_all
from traceline.operators.pivots import build_pivots, nearest_pivots, read_pivots
from traceline.runtime import fresh_path

DIM = 8


@pytest.fixture(scope="module")
def data(spark):
    """Vectors with many copies, a zero vector and a missing one, in two repositories."""
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(300, DIM)).astype(np.float32)
    vectors[100:200] = vectors[0]
    vectors[7] = 0
    repos = ["big" if i % 3 else "small" for i in range(300)]
    files = [(repos[i], i, f"d{i}/f.php", None if i == 8 else [float(x) for x in v]) for i, v in enumerate(vectors)]
    asks = [(i, [float(x) for x in vectors[i]]) for i in range(0, 300, 10)]
    index = spark.createDataFrame(files, "repo_id string, idx long, path string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(asks, "q int, embedding array<float>")
    return index, queries, vectors.astype(float), repos


def brute(vectors, repos, asks, k):
    length = np.linalg.norm(vectors, axis=1)
    found = set()
    for repo in set(repos):
        members = [i for i in range(len(vectors)) if repos[i] == repo and length[i] and i != 8]
        for q in asks:
            sims = {i: round(float(vectors[i] @ vectors[q] / length[i] / length[q]), 9) for i in members}
            order = sorted(members, key=lambda i: (-sims[i], i))[: k or len(members)]
            found |= {(repo, q, rk, i) for rk, i in enumerate(order, 1)}
    return found


@pytest.mark.parametrize("k", [1, 5, 40, 500])
def test_exact_search_equals_brute_force(data, k):
    index, queries, vectors, repos = data
    got = nearest(index, queries, k, DIM, by=["q"]).select("repo_id", "q", "rk", "idx").collect()
    assert set(map(tuple, got)) == brute(vectors, repos, range(0, 300, 10), k)
    assert len(got) == len(set(got))


@pytest.mark.parametrize("k", [3, None])
def test_large_query_side_is_blocked_with_the_same_result(data, k):
    index, queries, vectors, repos = data
    found = nearest(index, queries, k, DIM, by=["q"], broadcast_bytes=8 * DIM * 10)
    if k is None:
        found = rank_all(found, by=["q"])
    assert set(map(tuple, found.select("repo_id", "q", "rk", "idx").collect())) == brute(vectors, repos, range(0, 300, 10), k)


@pytest.mark.parametrize("k", [1, 4, 250])
@pytest.mark.parametrize("broadcast_bytes", [2**26, 8 * DIM * 7])
def test_rings_give_the_exact_neighbours(data, k, broadcast_bytes):
    """Copies, a zero and a missing vector, several repositories, and more queries than are sent at once."""
    index, queries, vectors, repos = data
    path = fresh_path(index.sparkSession, "pivots")
    build_pivots(index, DIM, ["repo_id"], ["path"], count=6, ring_rows=9, path=path)
    built = read_pivots(index.sparkSession, path)
    found = nearest_pivots(built, queries, k, DIM, by=["q"], broadcast_bytes=broadcast_bytes)
    assert set(map(tuple, found.select("repo_id", "q", "rk", "idx").collect())) == brute(vectors, repos, range(0, 300, 10), k)
    assert nearest_pivots(build_pivots(index.limit(0), DIM, ["repo_id"], ["path"]), queries, k, DIM, by=["q"]).count() == 0


def test_far_rings_are_skipped_and_the_index_is_not_moved(spark):
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(12, 16))
    rows = np.repeat(centres, 100, axis=0) + 0.05 * draw.normal(size=(1200, 16))
    schema = "repo_id string, idx long, path string, embedding array<float>"
    index = spark.createDataFrame([("r", i, "p", v) for i, v in enumerate(rows.tolist())], schema)
    asks = spark.createDataFrame([(i, v) for i, v in enumerate((centres + 0.01).tolist())], "q int, embedding array<float>")
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    built = build_pivots(index, 16, ["repo_id"], ["path"], count=12, ring_rows=25)
    found = nearest_pivots(built, asks, 3, 16, by=["q"], rings=counts)
    want = nearest(index, asks, 3, 16, by=["q"])
    assert set(map(tuple, found.select("q", "rk", "idx").collect())) == set(map(tuple, want.select("q", "rk", "idx").collect()))
    total, skipped = (c.value for c in counts)
    assert skipped > 0.5 * total > 0
    # Whatever the number of queries, what is moved are hits: the vectors are in no exchange.
    for search in (lambda b: nearest(index, asks, 3, 16, by=["q"], broadcast_bytes=b), lambda b: nearest_pivots(built, asks, 3, 16, by=["q"], broadcast_bytes=b)):
        for broadcast_bytes in (2**26, 8 * 16 * 5):
            plan = search(broadcast_bytes)._jdf.queryExecution().optimizedPlan().toString()
            moved = [line for line in plan.splitlines() if "Repartition" in line or "Join" in line]
            assert not moved and "cos_sim" in plan.split("Window")[1]


def test_blocks_cover_everything(data):
    index, queries, vectors, repos = data
    found = nearest_blocked(index, queries, 4, DIM, ["repo_id"], ["q"], ["path"], block_rows=16)
    assert set(map(tuple, found.select("repo_id", "q", "rk", "idx").collect())) == brute(vectors, repos, range(0, 300, 10), 4)


def test_complete_ranking(data):
    index, queries, vectors, repos = data
    found = rank_all(nearest(index, queries, None, DIM, by=["q"]), by=["q"])
    assert set(map(tuple, found.select("repo_id", "q", "rk", "idx").collect())) == brute(vectors, repos, range(0, 300, 10), None)


def test_own_file_is_at_distance_zero(data):
    index, queries, *_ = data
    own = nearest(index, queries, 1, DIM, scope=[], by=["q"]).select(F.max("distance"), F.min("distance")).first()
    assert tuple(own) == (0.0, 0.0)


def test_wrong_dimension_raises(data):
    index, queries, *_ = data
    with pytest.raises(Exception, match="dimension mismatch"):
        nearest(index.withColumn("embedding", F.slice("embedding", 1, 4)), queries, 1, DIM, by=["q"]).collect()


def test_no_queries_give_no_rows(data):
    index, queries, *_ = data
    assert nearest(index, queries.limit(0), 3, DIM, by=["q"]).count() == 0


@pytest.mark.parametrize("hashes", [4, 8, 12])
def test_approximate_search_reaches_the_recall(spark, hashes):
    """Whatever the number of hashes, with and without the way out to the exact search."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        F.lit("r").alias("repo_id"), F.col("vec_id").alias("idx"), F.lit("p").alias("path"), "embedding"
    )
    # Every other vector asks for its neighbours among the rest, so that no query finds itself.
    files, asks = table.where("idx % 2 = 1"), table.where("idx % 2 = 0").select(F.col("idx").alias("q"), "embedding")
    want = {(r.q, r.idx) for r in nearest(files, asks, 5, 64, by=["q"]).collect()}
    for most_share in (0.5, 1e9):
        found = nearest_lsh(files, asks, 5, 64, by=["q"], hashes=hashes, most_share=most_share, complete=False)
        assert len({(r.q, r.idx) for r in found.collect()} & want) >= 0.9 * len(want)


def test_near_neighbours_are_found_in_few_buckets(spark):
    """Where neighbours are near the plan looks at little of the index."""
    draw = np.random.default_rng(6)
    base = draw.normal(size=(1500, DIM))
    files = spark.createDataFrame([("r", i, "p", v) for i, v in enumerate(base.tolist())], "repo_id string, idx long, path string, embedding array<float>")
    asks = spark.createDataFrame([(i, v) for i, v in enumerate((base[:400] + 0.05 * draw.normal(size=(400, DIM))).tolist())], "q int, embedding array<float>")
    plan = choose_plan(files, asks, 1, DIM, ["repo_id"], ["q"], hashes=6)
    assert not plan.exact and plan.recall >= 0.9 and plan.tables * plan.probes / 64 <= 0.25
    found = nearest_lsh(files, asks, 1, DIM, by=["q"], plan=plan, block_rows=100, complete=False).collect()
    assert sum(r.q == r.idx for r in found) >= 0.9 * 400


def test_probes_go_from_the_nearest_line_on():
    sides = np.array([[[0.5, -0.1, 0.3]]])
    assert probe_codes(sides, 8).tolist() == [[[5, 7, 1, 3, 4, 6, 0, 2]]]  # 5 is 101: above the lines 0 and 2
    ranks = [probe_ranks(sides, np.array([[[a, b, c]]]))[0, 0] for a, b, c in [(1, -1, 1), (1, 1, 1), (1, -1, -1), (-1, 1, -1)]]
    assert ranks == [1, 2, 3, 8]


def test_plan_is_the_cheapest_that_reaches_the_recall():
    ranks = np.array([[1, 1], [3, 1], [9, 2], [1, 9]] * 100)
    assert solve_plan(ranks, 4, 0.7, 1.0, 0) == ProbePlan(4, 2, 1, 0, 0.75)
    assert solve_plan(ranks, 4, 0.99, 1.0, 0) == ProbePlan(4, 2, 2, 0, 1.0)
    assert solve_plan(ranks, 4, 0.99, 0.2, 0).exact and solve_plan(ranks + 2**29, 4, 0.1, 1.0, 0).exact


@pytest.mark.parametrize("scope", [["repo_id"], []])
def test_approximate_search_scores_the_probed_buckets_exactly(data, scope):
    """Against buckets made by hand; copies fill one bucket far beyond a block, and the index is read back from files."""
    index, queries, vectors, repos = data
    spark = index.sparkSession
    copies = spark.createDataFrame([("a", 1000 + i, "c", vectors[9].tolist()) for i in range(90)], "repo_id string, idx long, path string, embedding array<float>")
    index = index.select("repo_id", "idx", "path", "embedding").unionByName(copies.select("repo_id", "idx", "path", "embedding"))
    plan = ProbePlan(3, 2, 3, seed=5)
    path = fresh_path(spark, "buckets")
    build_buckets(index, DIM, plan, scope, ["path"] + (["repo_id"] if not scope else []), 16, path)
    again = read_buckets(spark, path)
    assert again.plan == plan
    found = search_buckets(again, queries, 4, scope, ["q"], ["path"], 8)
    rows = [(r.repo_id, r.idx, np.array(r.embedding, dtype=np.float64)) for r in index.collect() if r.embedding is not None and any(r.embedding)]
    unit = np.array([v / np.linalg.norm(v) for *_, v in rows])
    signs = lines(DIM, 6, 5).astype(float)
    far = (unit @ signs / np.sqrt(DIM)).reshape(len(rows), 2, 3)
    codes = ((far >= 0) * [1, 2, 4]).sum(axis=2)
    want = set()
    for q in queries.collect():
        if q.embedding is None or not any(q.embedding):
            continue
        v = np.array(q.embedding, dtype=np.float64)
        v /= np.linalg.norm(v)
        probed = probe_codes((v @ signs / np.sqrt(DIM)).reshape(1, 2, 3), 3)[0]
        alive = [i for i in range(len(rows)) if any(codes[i, t] in probed[t] for t in range(2))]
        by = {}
        for i in alive:
            by.setdefault(rows[i][0] if scope else None, []).append((-round(float(unit[i] @ v), 9), rows[i][1]))
        want |= {(s, q.q, rk + 1, idx) for s, hits in by.items() for rk, (_, idx) in enumerate(sorted(hits)[:4])}
    assert {(r.repo_id if scope else None, r.q, r.rk, r.idx) for r in found.collect()} == want


@pytest.mark.parametrize("scope", [["repo_id"], []])
def test_short_answers_are_searched_exactly(data, scope):
    index, queries, vectors, repos = data
    repos = repos if scope else [None] * 300
    found = nearest_lsh(index, queries, 250, DIM, scope=scope, by=["q"], plan=ProbePlan(6, 1, 1))
    assert found.count() == len(brute(vectors, repos, range(0, 300, 10), 250))


@pytest.mark.parametrize("pending", [1, 50, 10_000])
def test_running_best_of_a_task(pending):
    draw = np.random.default_rng(2)
    table = pa.table({"g": draw.integers(0, 4, 500), "idx": np.arange(500), "cos_sim": draw.integers(0, 9, 500) / 10})
    found = pa.Table.from_batches(list(keep_best(table.to_batches(max_chunksize=20), 3, ["g"], pending))).to_pandas()
    best = lambda frame: frame.sort_values(["g", "cos_sim", "idx"], ascending=[True, False, True]).groupby("g").head(3)
    assert best(found).values.tolist() == best(table.to_pandas()).values.tolist()
    assert pending < 50 or len(found) <= 12 + pending


def test_copies_of_a_row_do_not_grow_with_small_blocks(data, monkeypatch):
    """Blocks of two rows would copy every file 15 times and every query 150 times."""
    index, queries, vectors, repos = data
    moved, grouped = [], knn.nearest_grouped
    monkeypatch.setattr(knn, "nearest_grouped", lambda left, right, *a: moved.append((left.count(), right.count())) or grouped(left, right, *a))
    found = nearest_blocked(index, queries, 4, DIM, ["repo_id"], ["q"], ["path"], block_rows=2)
    assert set(map(tuple, found.select("repo_id", "q", "rk", "idx").collect())) == brute(vectors, repos, range(0, 300, 10), 4)
    assert moved[0][0] <= knn.SIDE_BLOCKS * 300 and moved[0][1] <= knn.SIDE_BLOCKS * 30


def test_the_index_is_made_once_for_all_parts_of_the_queries(data):
    index, queries, vectors, repos = data
    made = index.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    found = nearest(index.mapInArrow(count, index.schema), queries, 3, DIM, by=["q"], broadcast_bytes=8 * DIM * 10)
    assert set(map(tuple, found.select("repo_id", "q", "rk", "idx").collect())) == brute(vectors, repos, range(0, 300, 10), 3)
    assert made.value == 300


@pytest.mark.parametrize("kind", ["spread", "copies", "near ties"])
def test_single_precision_loses_no_neighbour(kind, monkeypatch):
    """Against all products in double, over several rounds and tables; few of the pairs become finds."""
    draw = np.random.default_rng(3)
    files = draw.normal(size=(3000, DIM))
    if kind == "copies":
        files[draw.random(3000) < 0.5] = files[0]
    elif kind == "near ties":
        files[1000:] = files[0] + 3e-8 * draw.normal(size=(2000, DIM))
    asks = np.concatenate([files[:40], draw.normal(size=(40, DIM))])
    unit, rows = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (files, asks))
    monkeypatch.setattr(knn, "ROUND_CELLS", 2**14)
    bars, got = knn.Bars(5, len(rows)), []
    for start in range(0, 3000, 1100):
        part = pa.table({"idx": np.arange(start, min(3000, start + 1100)), "embedding": pa.array(files[start : start + 1100].tolist())})
        got += knn.score_table(part, rows, pa.table({"q": np.arange(len(rows))}), 5, [], [], bars)
    best = knn.still_best(pa.Table.from_batches(got), 5, ["q"])
    sims = np.rint(rows @ unit.T * knn.UNIT) / knn.UNIT
    want = {(q, i) for q in range(len(rows)) for i in np.lexsort((np.arange(3000), -sims[q]))[:5].tolist()}
    assert set(zip(best.column("q").to_pylist(), best.column("idx").to_pylist())) == want
    assert sum(p.num_rows for p in got) < 0.1 * sims.size


def test_small_batches_of_finds_do_not_pile_up():
    """What waits is held in few batches, however small the ones that come."""
    held = []

    def parts():
        for i in range(3 * knn.LOOSE_BATCHES):
            held.append(sys.getrefcount(first))
            yield first if i % 2 else pa.record_batch({"g": [0], "idx": [i], "cos_sim": [0.5]})

    first = pa.record_batch({"g": [1], "idx": [1], "cos_sim": [0.5]})
    out = list(keep_best(parts(), 2, ["g"], 10**6))
    assert sum(b.num_rows for b in out) == 4 and max(held) < knn.LOOSE_BATCHES


@pytest.mark.parametrize("scope", [["repo_id"], []])
@pytest.mark.parametrize("rows", [7, None])
def test_files_and_queries_that_meet_by_bucket_give_the_same(data, scope, rows, monkeypatch):
    """Buckets of more than a task takes, copies, and files that are found in two tables."""
    index, queries, *_ = data
    built = build_buckets(index, DIM, ProbePlan(3, 2, 3, seed=5), scope, ["path"], 16)
    columns = [*scope, "q", "rk", "idx", "path", "distance"]
    by_bucket = approximate._search_by_bucket(built, queries, 4, scope, ["q"], ["path"], rows).select(*columns).collect()
    monkeypatch.setattr(approximate, "PLACE_BYTES", 0)
    by_place = search_buckets(built, queries, 4, scope, ["q"], ["path"], 8).select(*columns).collect()
    assert sorted(by_bucket) == sorted(by_place) and len(by_place) > 100


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies", "scopes"])
def test_leaves_lose_no_neighbour(kind, monkeypatch):
    """Against all products in double; near clusters, whole leaves are not multiplied."""
    draw = np.random.default_rng(5)
    files = draw.normal(size=(4000, DIM))
    if kind == "clusters":
        files = 8 * np.eye(DIM)[draw.integers(0, 4, 4000)] + 0.3 * files
    elif kind == "copies":
        files[draw.random(4000) < 0.7] = files[0]
    asks = np.concatenate([files[:60], files[100:160] + 0.1 * draw.normal(size=(60, DIM)), draw.normal(size=(20, DIM))])
    unit, rows = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (files, asks))
    scope = np.arange(4000) % (2 if kind == "scopes" else 1)
    monkeypatch.setattr(knn, "LEAF_QUERIES", 50)
    monkeypatch.setattr(knn, "LEAF_ROWS", 64)
    monkeypatch.setattr(knn, "ROUND_CELLS", 2**13)
    cells, whole = [], knn._promising
    monkeypatch.setattr(knn, "_promising", lambda rows, files, *a: cells.append(len(rows) * len(files)) or whole(rows, files, *a))
    bars, ask, got = knn.Bars(5, len(rows)), knn.Asks(rows), []
    for start in range(0, 4000, 2000):
        at = np.arange(start, start + 2000)
        part = pa.table({"s": scope[at], "idx": at, "embedding": pa.array(files[at].tolist())})
        got += knn.score_table(part, rows, pa.table({"q": np.arange(len(rows))}), 5, ["s"], [], bars, ask)
    best = knn.still_best(pa.Table.from_batches(got), 5, ["s", "q"])
    sims = np.rint(rows @ unit.T * knn.UNIT) / knn.UNIT
    mine = [np.flatnonzero(scope == s) for s in np.unique(scope)]
    want = {(q, i) for q in range(len(rows)) for m in mine for i in m[np.lexsort((m, -sims[q, m]))[:5]].tolist()}
    assert set(zip(best.column("q").to_pylist(), best.column("idx").to_pylist())) == want
    assert kind != "clusters" or sum(cells) < 0.5 * sims.size


def test_parts_of_the_queries_are_worked_off_side_by_side(data, monkeypatch):
    index, queries, vectors, repos = data
    written, store = [], knn.stored
    monkeypatch.setattr(knn, "stored", lambda df, label: written.append(label) or store(df, label))
    found = nearest(index, queries, 3, DIM, by=["q"], broadcast_bytes=8 * DIM * 10)
    assert set(map(tuple, found.select("repo_id", "q", "rk", "idx").collect())) == brute(vectors, repos, range(0, 300, 10), 3)
    assert written.count("hits") == 2  # five parts


def test_batches_are_put_together_up_to_a_size():
    batches = [pa.record_batch({"idx": list(range(start, start + n))}) for start, n in ((0, 3), (3, 4), (7, 0), (7, 12), (19, 1))]
    for least, most in ((1, 5), (5, 5), (8, 8), (100, 100)):
        pieces = list(knn._pieces(batches, least, most))
        assert [i for p in pieces for i in p.column("idx").to_pylist()] == list(range(20))
        assert max(p.num_rows for p in pieces) <= most and all(p.column("idx").num_chunks == 1 for p in pieces)
    assert len(list(knn._pieces(batches, 1, 100))) == 4 and len(list(knn._pieces(batches, 100, 100))) == 1
