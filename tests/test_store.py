"""Versions, the vector store and the match kept in it."""

import itertools
import random
import threading

import pytest
from pyspark.sql import functions as F

from traceline.operators import vector_store
from traceline.operators.embed import HashModel, LoadedModel
from traceline.plans import kept_match
from traceline.plans.kept_match import kept_hits, live_best, maintain, match_kept, refresh
from traceline.plans.match import match_single
from traceline.sources.versions import Conflict, drop_versions, latest, publish, write_part

MODEL = HashModel("m", 16)
FILES = "repo_id string, pos long, path string, content string"
ROWS = [(0, "Login", "user password login"), (1, "Crypto", "cipher key"), (2, "Log", "log event"), (3, "Empty", "?!"), (4, "Gone", "[DELETED] x")]


@pytest.fixture
def requirements(spark):
    return spark.createDataFrame(ROWS, "row_idx long, section_name string, req_description string")


def table(spark, files):
    return spark.createDataFrame([(r, i, p, t) for i, (r, p, t) in enumerate(files)], FILES)


def listed(results):
    return sorted(map(tuple, results.select("repo_id", "section_name", "first_row", "kind", "pos", "file_name", F.round("score", 9)).collect()), key=repr)


# Versions


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert latest(spark, path) is None
    one = publish(spark, path, None, {"t": (write_part(spark.range(3), path, "t"),)}, "first")
    pinned = latest(spark, path).read(spark, "t", "id long")
    # Written but not published: nobody sees it.
    loose = write_part(spark.range(3, 10), path, "t")
    assert latest(spark, path) == one and latest(spark, path).read(spark, "t", "id long").count() == 3
    two = publish(spark, path, one, {"t": (*one.tables["t"], loose)})
    assert pinned.count() == 3 and latest(spark, path) == two and two.read(spark, "t", "id long").count() == 10
    three = publish(spark, path, two, {"t": (write_part(spark.range(1), path, "t"),)})
    assert pinned.count() == 3 and three.read(spark, "t", "id long").count() == 1
    assert three.read(spark, "other", "x string").count() == 0


def test_of_two_writers_one_is_told(spark, tmp_path):
    path = str(tmp_path / "t")
    base = publish(spark, path, None, {})
    outcomes = []

    def write(n):
        try:
            outcomes.append(publish(spark, path, base, {"t": (write_part(spark.range(n), path, "t"),)}).version)
        except Conflict:
            outcomes.append("conflict")

    for n in (1, 2):
        write(n)
    assert outcomes == [2, "conflict"] and latest(spark, path).read(spark, "t", "id long").count() == 1


def test_readers_during_writes_see_whole_versions(spark, tmp_path):
    """Every version holds its own number only; a reader never sees two of them."""
    path = str(tmp_path / "t")
    base = publish(spark, path, None, {"t": (write_part(spark.range(50).withColumn("v", F.lit(1)), path, "t"),)})
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            found = latest(spark, path)
            rows = found.read(spark, "t", "id long, v int").agg(F.count("*"), F.min("v"), F.max("v")).first()
            seen.append((tuple(rows), found.version))

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(2, 7):
        base = publish(spark, path, base, {"t": (write_part(spark.range(50).withColumn("v", F.lit(v)), path, "t"),)})
    stop.set()
    reader.join()
    assert seen and all(row == (50, v, v) for row, v in seen)


def test_old_versions_go_with_their_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    shared = write_part(spark.range(1), path, "t")
    version = None
    for n in range(4):
        version = publish(spark, path, version, {"t": (shared, write_part(spark.range(n + 1), path, "t"))})
    loose = write_part(spark.range(9), path, "t")
    gone = drop_versions(spark, path, keep=1)
    assert len(gone) == 3 and shared not in gone and latest(spark, path) == version
    assert version.read(spark, "t", "id long").count() == 5
    left = {f"data/{p.name}" for p in (tmp_path / "t" / "data").iterdir()}
    assert left == {*version.tables["t"], loose} and len(list((tmp_path / "t" / "manifests").iterdir())) == 1
    with pytest.raises(ValueError):
        drop_versions(spark, path, keep=0)


# Vectors and lists


def test_nothing_is_embedded_or_scored_twice(spark, requirements, tmp_path):
    """The model itself counts the texts it sees."""
    seen = spark.sparkContext.accumulator(0)

    def load():
        def embed(texts):
            seen.add(len(texts))
            return [[float(len(t)), float(t.count("o")), 1.0] for t in texts]

        return embed

    model, path = LoadedModel("counted", 3, load), str(tmp_path / "s")
    files = [("a", f"f{i}.py", "o" * i + "x" * (i % 3)) for i in range(1, 9)]
    first = refresh(spark, path, table(spark, files), requirements, model, depth=2)
    assert (first.embedded, first.sections, seen.value) == (8, 4, 12)  # and four sections
    again = refresh(spark, path, table(spark, files), requirements, model, depth=2)
    assert again.snapshot == first.snapshot and seen.value == 12
    assert (again.embedded, again.moved, again.removed, again.sections, again.recomputed) == (0, 0, 0, 0, 0)
    files[3] = ("a", "f4.py", "entirely new o")
    third = refresh(spark, path, table(spark, files + [("b", "new.py", "oo")]), requirements, model, depth=2)
    assert (third.embedded, third.sections, seen.value) == (2, 0, 14)
    # Only places change: no text is embedded.
    fourth = refresh(spark, path, table(spark, [("b", "new.py", "oo"), *files]), requirements, model, depth=2)
    assert (fourth.embedded, fourth.moved, seen.value) == (0, 9, 14)
    with pytest.raises(ValueError, match="was made for"):
        refresh(spark, path, table(spark, files), requirements, HashModel("other", 3), depth=2)
    with pytest.raises(Exception, match="two files of one path"):
        refresh(spark, path, table(spark, [*files, files[0]]), requirements, model, depth=2)


def test_failed_texts_are_kept_with_their_error(spark, requirements, tmp_path):
    path, model = str(tmp_path / "s"), HashModel("picky", 16, refuse="@")
    files = table(spark, [("a", "x.py", "a@b"), ("a", "y.py", "log"), ("a", "z.py", "...")])
    done = refresh(spark, path, files, requirements, model)
    rows = {r.path: r.error for r in vector_store.live_vectors(spark, done.snapshot).collect()}
    assert rows == {"x.py": "refused text", "y.py": None, "z.py": "no words"}
    assert refresh(spark, path, files, requirements, model).snapshot == done.snapshot


WORDS = ["login", "user", "password", "cipher", "key", "log", "event", "other", "x", "..."]


def test_kept_match_equals_a_new_one_after_any_changes(spark, requirements, rows, tmp_path):
    """Files and sections come, change, move and go; the store always gives what a match from scratch gives."""
    draw = random.Random(11)
    path = str(tmp_path / "s")
    files = {(f"r{i % 3}", f"d{i}/f{i % 7}.py"): " ".join(draw.choices(WORDS, k=3)) for i in range(40)}
    asked = list(ROWS)
    for step in range(6):
        if step:
            for key in draw.sample(sorted(files), {1: 5, 2: 25, 3: 3, 4: 0, 5: 2}[step]):
                if draw.random() < 0.6 or step == 2:
                    del files[key]
                else:
                    files[key] = " ".join(draw.choices(WORDS, k=3))
            for i in range(4):
                files[f"r{draw.randrange(4)}", f"new{step}/{i}.py"] = " ".join(draw.choices(WORDS, k=3))
        if step == 3:
            asked[1] = (1, "Crypto", "cipher other")
        if step == 4:
            asked.append((9, "Late", "event key"))
            files = {k: v for k, v in files.items() if k[0] != "r1"}  # a whole repository goes
        if step == 5:
            del asked[0]
        # From the fourth step on the places of all files change, too.
        order = sorted(files) if step < 3 else draw.sample(sorted(files), len(files))
        given = table(spark, [(r, p, files[r, p]) for r, p in order])
        reqs = spark.createDataFrame(asked, requirements.schema)
        kept = match_kept(spark, path, given, reqs, MODEL, depth=2, min_distance=None)
        assert listed(kept) == listed(match_single(given, reqs, MODEL, depth=2, min_distance=None))
    assert latest(spark, path).version == 6


def test_lists_are_searched_again_only_when_they_run_out(spark, requirements, tmp_path):
    path, requirements = str(tmp_path / "s"), requirements.where("section_name = 'Log'")
    files = [("a", f"f{i}.py", "log event" + " x" * i) for i in range(20)]
    refresh(spark, path, table(spark, files), requirements, MODEL, depth=2, reserve=5)
    few = refresh(spark, path, table(spark, [*files[:1], *files[2:]]), requirements, MODEL, depth=2, reserve=5)
    many = refresh(spark, path, table(spark, files[9:]), requirements, MODEL, depth=2, reserve=5)
    assert (few.removed, few.recomputed) == (1, 0) and many.recomputed > 0
    names = {r.path for r in kept_hits(spark, many.snapshot, 2).where("section_name = 'Log'").collect()}
    assert names == {"f9.py", "f10.py"}
    with pytest.raises(ValueError, match="depth of 2"):
        kept_hits(spark, many.snapshot, 3)


def test_lists_by_brute_force(spark):
    """All ways in which one short list can lose and gain files."""
    files = {f"o{i}": 1 - i / 10 for i in range(5)} | {f"n{i}": 0.95 - i / 5 for i in range(3)}
    idx = {f: i for i, f in enumerate(files)}
    cases = []
    for n, lost in itertools.product((3, 5), itertools.chain.from_iterable(itertools.combinations(range(3), m) for m in range(4))):
        for new in itertools.chain.from_iterable(itertools.combinations(range(3), m) for m in range(4)):
            cases.append((f"{n}-{lost}-{new}", n, lost, new))
    entry = "repo_id string, section_name string, first_row long, idx long, path string, cos_sim double"
    row = lambda repo, f: (repo, "s", 0, idx[f], f, files[f])
    old = spark.createDataFrame([row(c, f"o{i}") for c, *_ in cases for i in range(3)], entry)
    gone = spark.createDataFrame([(c, f"o{i}") for c, _, lost, _ in cases for i in lost] + [("x", "x")], "repo_id string, path string")
    fresh = spark.createDataFrame([row(c, f"n{i}") for c, _, _, new in cases for i in new], entry)
    sizes = spark.createDataFrame([(c, n) for c, n, *_ in cases], "repo_id string, n long")
    found = {}
    still = spark.createDataFrame([], "repo_id string, path string, pos long")
    for r in maintain(old, gone, still, fresh, sizes, 2, 3).collect():
        found.setdefault(r.repo_id, []).append(r)
    for c, n, lost, new in cases:
        got = found[c]
        valid = [r.path for r in sorted((r for r in got if r.valid), key=lambda r: r.idx)]
        everything = [f"o{i}" for i in range(n) if i not in lost] + [f"n{i}" for i in new]
        best = sorted(everything, key=lambda f: (-files[f], idx[f]))
        if any(r.again for r in got):
            assert len(valid) < 2 and n == 5
        else:
            assert sorted(valid) == sorted(best[: len(valid)]) and len(valid) >= min(2, len(best))


def test_moved_files_keep_their_lists(spark):
    """Ties with the last entry are open after a move; what is nearer stays, under its new place."""
    entry = "repo_id string, section_name string, first_row long, idx long, path string, cos_sim double"
    old = spark.createDataFrame([("a", "s", 0, i, f"f{i}", c) for i, c in enumerate((0.9, 0.8, 0.7, 0.7))], entry)
    moved = spark.createDataFrame([("a", f"f{i}", 13 - i) for i in range(4)], "repo_id string, path string, pos long")
    fresh = spark.createDataFrame([("a", "s", 0, 0, "n0", 0.8), ("a", "s", 0, 1, "n1", 0.7)], entry)
    gone = moved.limit(0).drop("pos")
    for n, want in ((9, [(13, "f0"), (0, "n0"), (12, "f1")]), (4, [(13, "f0"), (0, "n0"), (12, "f1"), (1, "n1")])):
        sizes = spark.createDataFrame([("a", n)], "repo_id string, n long")
        found = maintain(old, gone, moved, fresh, sizes, 2, 4).where("valid").collect()
        assert [(r.idx, r.path) for r in sorted(found, key=lambda r: (-r.cos_sim, r.idx))] == want
        assert not any(r.again for r in found)


def test_store_is_compacted(spark, requirements, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    monkeypatch.setattr(kept_match, "MAX_FOLDERS", 2)
    for step in range(4):
        files = table(spark, [("a", f"f{i}.py", f"log {'x' * (step if i < 6 else 0)}") for i in range(10)])
        done = refresh(spark, path, files, requirements, MODEL)
    assert len(done.snapshot.tables["best"]) <= 2 and len(done.snapshot.tables["vectors"]) == 1
    assert vector_store.live_vectors(spark, done.snapshot).count() == 10
    assert live_best(spark, done.snapshot).where("section_name = 'Log'").count() == 10
    assert len(drop_versions(spark, path, keep=1)) > 0
    assert refresh(spark, path, files, requirements, MODEL).snapshot == done.snapshot
