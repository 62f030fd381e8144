import base64
import json

import pytest
from pyspark.sql import functions as F

from traceline.functions.text import base_name
from traceline.operators.documents import chunks
from traceline.operators.embed import HashModel, embed_two_models
from traceline.operators.knn import nearest, rank_all, score_both
from traceline.operators.requirements import clean_requirements, section_vectors
from traceline.plans.match import dual_results, match_dual, match_single
from traceline.plans.search import document_context, search
from traceline.sources.readers import decode_files, read_payload
from traceline.streaming.jobs import match_stream, read_payload_stream, read_runs, run_states

MODEL = HashModel("m", 32)
OTHER = HashModel("n", 16, 8)
REPOS = {
    "one": {"src/login.php": "login user password session", "src/crypt.php": "encrypt key cipher algorithm", "README.txt": "login"},
    "two": {"log.py": "write log event", "deep/login.php": "user login form", "other/login.php": "nothing like it"},
}
REQUIREMENTS = [(0, "Login", "user password login"), (1, "Crypto", "cipher key (see x)"), (2, "Login", "session"), (3, "Log", "[DELETED] log"), (4, "Log", "log event")]


@pytest.fixture
def requirements(spark):
    return spark.createDataFrame(REQUIREMENTS, "row_idx long, section_name string, req_description string")


def write(path, repos, broken=()):
    path.mkdir(exist_ok=True)
    for repo, tree in repos.items():
        blobs = {n: {"type": "blob", "encode": "base64", "content": base64.b64encode(t.encode()).decode()} for n, t in tree.items()}
        if repo in broken:
            next(iter(blobs.values()))["content"] = "A"
        (path / f"{repo}.json").write_text(json.dumps({"id": repo, "repository_tree": blobs}))


def test_single_model_finds_the_right_files(spark, requirements, tmp_path):
    write(tmp_path / "in", REPOS)
    files = decode_files(read_payload(spark, str(tmp_path / "in")))
    found = match_single(files, requirements, MODEL, depth=1, min_distance=None)
    assert sorted((r.repo_id, r.section_name, r.file_name) for r in found.collect()) == [
        ("one", "Crypto", "crypt.php"), ("one", "Log", found.where("repo_id = 'one' and section_name = 'Log'").first().file_name),
        ("one", "Login", "login.php"), ("two", "Crypto", found.where("repo_id = 'two' and section_name = 'Crypto'").first().file_name),
        ("two", "Log", "log.py"), ("two", "Login", "login.php"),
    ]
    deeper = match_single(files, requirements, MODEL, depth=2, min_distance=None)
    shallow = {(r.repo_id, r.section_name, r.file_name) for r in found.collect()}
    assert shallow <= {(r.repo_id, r.section_name, r.file_name) for r in deeper.collect()}


def test_dual_model_lists_every_file_once(spark, requirements, tmp_path):
    write(tmp_path / "in", REPOS)
    files = decode_files(read_payload(spark, str(tmp_path / "in")))
    found = match_dual(files, requirements, MODEL, OTHER, min_distance=None).collect()
    listed = sorted((r.repo_id, r.section_name, r.file_name) for r in found)
    names = {"one": ["crypt.php", "login.php"], "two": ["log.py", "login.php"]}
    assert listed == sorted((r, s, n) for r in names for s in ("Login", "Crypto", "Log") for n in names[r])
    assert {r.kind for r in found} == {"common_files"}


def test_short_dual_lists_equal_cut_rankings(spark, requirements, rows, tmp_path):
    """With a depth each model's list ends there; complete rankings cut at it give the same."""
    write(tmp_path / "in", REPOS)
    files = decode_files(read_payload(spark, str(tmp_path / "in")))
    cleaned = clean_requirements(requirements)
    index = embed_two_models(files.withColumnRenamed("pos", "idx"), "content", MODEL, OTHER)

    def cut(model, vector):
        one = index.select("repo_id", "idx", base_name(F.col("path")).alias("path"), F.col(vector).alias("embedding"))
        every = nearest(one, section_vectors(cleaned, model), None, model.dim, by=["section_name", "first_row"])
        return rank_all(every, by=["section_name"]).where("rk <= 1")

    want = dual_results(cut(MODEL, "embedding_1"), cut(OTHER, "embedding_2"), None, 1)
    columns = ["repo_id", "section_name", "kind", "pos", "file_name", F.round("score", 9)]
    assert rows(match_dual(files, requirements, MODEL, OTHER, None, depth=1), *columns) == rows(want, *columns)


def test_one_pass_scores_two_models(spark, rows):
    """NULL query vectors, unequal dimensions and more queries than are sent at once."""
    index = spark.createDataFrame([("a", "x", [1.0, 0.0], [1.0]), ("a", "y", [1.0, 1.0], [-1.0])], "repo_id string, path string, embedding_1 array<float>, embedding_2 array<float>")
    asks = spark.createDataFrame([("p", [1.0, 0.0], [2.0]), ("q", None, [1.0]), ("r", [0.0, 3.0], None)], "s string, embedding_1 array<float>, embedding_2 array<float>")
    half = round(0.5**0.5, 9)
    want = [("p", "x", 1.0, 1.0), ("p", "y", half, -1.0), ("q", "x", None, 1.0), ("q", "y", None, -1.0), ("r", "x", 0.0, None), ("r", "y", half, None)]
    for broadcast_bytes in (2**20, 24):
        found = score_both(index, asks, (2, 1), ["repo_id"], ["s"], ["path"], broadcast_bytes)
        assert rows(found, "s", "path", "cos_1", "cos_2") == want


def test_stream_equals_batch_and_a_rerun_adds_nothing(spark, requirements, rows, tmp_path):
    inbox = tmp_path / "in"
    write(inbox, {**REPOS, "bad": {"x.php": "text"}}, broken=["bad"])
    results, runs, checkpoint = (str(tmp_path / n) for n in ("results", "runs", "checkpoint"))

    def run():
        stream = read_payload_stream(spark, str(inbox), files_per_batch=2)
        match_stream(stream, requirements, MODEL, results, runs, checkpoint).awaitTermination()
        return rows(read_runs(spark, runs), "repo_id", "state", "error")

    assert run() == [("bad", "FAILURE", "x.php: incorrect base64 padding"), ("one", "SUCCESS", None), ("two", "SUCCESS", None)]
    columns = ["repo_id", "section_name", "kind", "pos", "file_name", F.round("score", 9)]
    files = decode_files(read_payload(spark, str(inbox)), on_error="null").where("repo_id <> 'bad'")
    batch = rows(match_single(files.drop("error"), requirements, MODEL), *columns)
    assert rows(spark.read.parquet(results), *columns) == batch
    assert len(run()) == 3
    assert rows(spark.read.parquet(results), *columns) == batch


def drop(path, name, repo, tree, part=None, parts=None):
    path.mkdir(exist_ok=True)
    blobs = {n: {"type": "blob", "encode": "base64", "content": base64.b64encode(t.encode()).decode()} for n, t in tree.items()}
    given = {"id": repo, "repository_tree": blobs, "part": part, "parts": parts}
    (path / name).write_text(json.dumps({k: v for k, v in given.items() if v is not None}))


def test_parts_of_a_repository_are_one_job(spark, requirements, rows, tmp_path):
    """Two parts in two batches, and over two runs, give the results of the whole repository, once."""
    inbox = tmp_path / "in"
    results, runs, checkpoint = (str(tmp_path / n) for n in ("results", "runs", "checkpoint"))

    def run():
        stream = read_payload_stream(spark, str(inbox), files_per_batch=1)
        match_stream(stream, requirements, MODEL, results, runs, checkpoint, depth=1, min_distance=None).awaitTermination()
        return rows(read_runs(spark, runs), "repo_id", "state", "error")

    halves = [dict(list(REPOS["one"].items())[:1]), dict(list(REPOS["one"].items())[1:])]
    drop(inbox, "a.json", "one", halves[0], 0, 2)
    drop(inbox, "b.json", "two", REPOS["two"])
    assert run() == [("two", "SUCCESS", None)]
    drop(inbox, "c.json", "one", halves[0], 0, 2)  # sent twice: still one of two parts
    drop(inbox, "d.json", "bare", {"read.me": "nothing to match"})
    assert run() == [("bare", "SUCCESS", None), ("two", "SUCCESS", None)]
    drop(inbox, "e.json", "one", halves[1], 1, 2)
    assert run() == [("bare", "SUCCESS", None), ("one", "SUCCESS", None), ("two", "SUCCESS", None)]
    trees = spark.createDataFrame([("bare",)], "repo_id string")
    whole = tmp_path / "whole"
    write(whole, REPOS)
    files = decode_files(read_payload(spark, str(whole)))
    every = files.select("repo_id").unionByName(trees)
    batch = match_single(files, requirements, MODEL, depth=1, min_distance=None, repos=every)
    columns = ["repo_id", "section_name", "kind", "pos", "file_name", F.round("score", 9)]
    found = spark.read.parquet(results)
    assert rows(found, *columns) == rows(batch, *columns)
    assert rows(found.where("repo_id = 'bare'"), "section_name", "file_name") == [("Crypto", None), ("Log", None), ("Login", None)]
    # The same repository again is a new job.
    drop(inbox, "f.json", "two", REPOS["two"])
    assert run().count(("two", "SUCCESS", None)) == 2


def test_a_missing_part_and_bad_payloads_fail_by_name(spark, requirements, rows, tmp_path):
    inbox = tmp_path / "in"
    results, runs, checkpoint = (str(tmp_path / n) for n in ("results", "runs", "checkpoint"))

    def run():
        stream = read_payload_stream(spark, str(inbox), files_per_batch=1)
        match_stream(stream, requirements, MODEL, results, runs, checkpoint, patience_ms=1).awaitTermination()
        return rows(read_runs(spark, runs), "repo_id", "state", "error")

    drop(inbox, "a.json", "one", REPOS["one"], 0, 3)
    (inbox / "b.json").write_text("not json\n")
    (inbox / "c.json").write_text('{"repository_tree": {}}\n')
    drop(inbox, "d.json", "two", {"b.py": "x"})
    write(inbox, {"bad": {"y.php": "text", "z.php": "more"}}, broken=["bad"])
    drop(inbox, "e.json", "last", {"b.py": "login"})
    assert run() == [
        ("bad", "FAILURE", "y.php: incorrect base64 padding"),
        ("last", "SUCCESS", None),
        ("one", "FAILURE", "incomplete: 1 of 3 parts"),
        ("two", "SUCCESS", None),
        (None, "FAILURE", "not a payload with an id: b.json"),
        (None, "FAILURE", "not a payload with an id: c.json"),
    ]
    assert {r.repo_id for r in spark.read.parquet(results).select("repo_id").distinct().collect()} == {"two", "last"}


def test_every_repository_and_section_has_a_row(spark, rows):
    """A file without words, a repository without files and a section without words are in the results."""
    files = spark.createDataFrame(
        [("a", 0, "x.py", "login user"), ("b", 0, "y.py", "... !?")], "repo_id string, pos long, path string, content string"
    )
    asked = spark.createDataFrame([(0, "Login", "login"), (1, "Marks", "?!")], "row_idx long, section_name string, req_description string")
    repos = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "repo_id string")
    empty = [(r, s, f, None, None) for r in "abc" for s, f in (("Login", 0), ("Marks", 1)) if (r, s) != ("a", "Login")]
    columns = ["repo_id", "section_name", "first_row", "kind", "file_name"]
    single = match_single(files, asked, MODEL, min_distance=None, repos=repos)
    assert rows(single, *columns) == sorted([("a", "Login", 0, "common_files", "x.py"), *empty], key=repr)
    dual = match_dual(files, asked, MODEL, OTHER, min_distance=None, repos=repos)
    assert rows(dual, *columns) == sorted([("a", "Login", 0, "common_files", "x.py"), *empty], key=repr)
    many = spark.createDataFrame([(i, f"s{i}", "login") for i in range(2500)], asked.schema)
    assert match_single(files, many, MODEL, min_distance=None).groupBy("repo_id").count().where("count = 2500").count() == 2


def test_search_listing_and_context(spark, rows):
    files = spark.createDataFrame([("d", 0, "a.txt", "alpha beta"), ("d", 1, "b.txt", "gamma delta"), ("d", 2, "c.txt", "alpha gamma")], "repo_id string, pos long, path string, content string")
    asks = spark.createDataFrame([(1, "alpha beta"), (2, "?")], "query_id int, query string")
    index = files.withColumnRenamed("pos", "idx").withColumn("e", MODEL.column(F.col("content"))).withColumn("embedding", F.col("e.embedding"))
    found = search(index, asks, MODEL, depth=2).orderBy("rk").collect()
    assert [(r.query_id, r.rk, r.path) for r in found] == [(1, 1, "a.txt"), (1, 2, "c.txt")]
    assert found[0].distance == 0
    assert rows(document_context(files, asks, MODEL, k=2)) == [(1, "alpha beta\n\nalpha gamma", 2)]


@pytest.mark.parametrize("n", [1, 10, 11, 18, 19, 26, 100])
def test_chunks_cover_the_whole_text(spark, n):
    words = [f"w{i}" for i in range(n)]
    table = spark.createDataFrame([("r", "p", " \n" + "\t ".join(words) + "\n")], "repo_id string, path string, content string")
    found = [r.content.split(" ") for r in chunks(table, size=10, overlap=2).orderBy("chunk").collect()]
    assert found[0] == words[:10]
    assert [w for i, c in enumerate(found) for w in (c if i == 0 else c[2:])] == words
    assert all(len(c) == 10 for c in found[:-1])


def test_a_payload_without_an_id_is_a_failure(spark, rows):
    payload = spark.createDataFrame([("r",), (None,)], "id string")
    decoded = spark.createDataFrame([], "repo_id string, path string, error string")
    assert rows(run_states(payload, decoded)) == [("r", "SUCCESS", None), (None, "FAILURE", "not a payload with an id")]
