import base64
import json

import pytest
from pyspark.sql import functions as F

from traceline.operators.embed import HashModel, embed
from traceline.operators.index import build_index, build_or_load, index_map, read_index, total_files, write_index
from traceline.operators.nest import combined_payload, nest_results, result_documents
from traceline.sources import readers, writers

MODEL = HashModel("m", 16)
RESULT = "repo_id string, section_name string, first_row long, kind string, pos long, file_name string, score double"


def b64(text):
    return base64.b64encode(text.encode()).decode()


def test_repo_tree_file(spark, rows, tmp_path):
    blob = lambda t: {"type": "blob", "encode": "base64", "content": b64(t)}
    path = tmp_path / "tree.json"
    path.write_text(json.dumps({"index.php": blob("<?php 1"), ".env.example": blob("K=1"), "app.php": blob("<?php 2")}, indent=1))
    tree = readers.read_repo_tree(spark, str(path), "323")
    assert rows(tree, "repo_id", "pos", "path") == [("323", 0, "index.php"), ("323", 1, ".env.example"), ("323", 2, "app.php")]
    assert rows(readers.decode_files(tree), "path", "content") == [("app.php", "<?php 2"), ("index.php", "<?php 1")]


def test_payload_with_a_numeric_id(spark, rows, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"id": 323, "repository_tree": {"a.py": {"content": b64("x")}, "b.py": {"content": b64("y")}}}, indent=2))
    assert rows(readers.read_payload(spark, str(path)), "repo_id", "pos", "path") == [("323", 0, "a.py"), ("323", 1, "b.py")]


def test_repeated_names_keep_the_last_blob(spark, rows, tmp_path):
    path = tmp_path / "p.json"
    blob = lambda t: '{"content": "%s"}' % b64(t)
    path.write_text('{"id": "r", "repository_tree": {"a.py": %s, "b.py": %s, "a.py": %s}}' % (blob("old"), blob("b"), blob("new")))
    files = readers.decode_files(readers.read_payload(spark, str(path)))
    assert rows(files, "pos", "path", "content") == [(0, "a.py", "new"), (1, "b.py", "b")]


def test_payloads_come_in_bounded_parts(spark, rows, tmp_path):
    files = spark.range(10).select(F.lit("r").alias("repo_id"), F.col("id").alias("pos"), F.concat(F.lit("f"), "id").alias("path"), F.lit("t").alias("content"))
    out = str(tmp_path / "out")
    writers.write_payloads(files, out, per_payload=4)
    assert spark.read.text(out).count() == 3
    read = readers.read_payload(spark, out, multiline=False).orderBy("pos")
    assert [r.path for r in read.collect()] == [f"f{i}" for i in range(10)]


def test_requirements_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('id,section_name,req_description\n1,"A, B and C","say ""hi"",\nnow"\n2,D,[DELETED]\n3,D,plain\n')
    found = readers.read_requirements(spark, str(path)).orderBy("row_idx").collect()
    assert [tuple(r) for r in found] == [(0, "A, B and C", 'say "hi",\nnow'), (1, "D", "[DELETED]"), (2, "D", "plain")]


def test_directory(spark, rows, tmp_path):
    (tmp_path / "d" / "sub dir").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("one\ntwo")
    (tmp_path / "d" / "sub dir" / "b.txt").write_text("three")
    root = str(tmp_path / "d")
    assert rows(readers.read_directory(spark, root), "path", "content") == [("a.txt", "one\ntwo")]
    assert rows(readers.read_directory(spark, root, recursive=True), "path", "content") == [("a.txt", "one\ntwo"), ("sub dir/b.txt", "three")]


def test_result_documents_of_several_models(spark, rows, tmp_path):
    one = '{"S": {"common_files": [["a \\"q\\".php", 0.5], ["b.php", 1e-3]], "only_one_model": []}, "E": {"common_files": [], "only_one_model": [["z.php", 0.1]]}, "N": {"common_files": [], "only_one_model": []}}'
    (tmp_path / "section_result_first.json").write_text(json.dumps(json.loads(one), indent=4))
    (tmp_path / "section_result_second.json").write_text('{"S": {"common_files": [["old.php", 1]]}, "S": {"common_files": [["new.php", 2]]}}')
    found = readers.read_results(spark, str(tmp_path), layout="document")
    assert rows(found, "model", "section_name", "kind", "pos", "file_name", "score") == [
        ("first", "E", "only_one_model", 1, "z.php", 0.1),
        ("first", "N", None, None, None, None),
        ("first", "S", "common_files", 1, 'a "q".php', 0.5),
        ("first", "S", "common_files", 2, "b.php", 0.001),
        ("second", "S", "common_files", 1, "new.php", 2.0),
    ]


def results(spark):
    table = [
        ("r", "S", 0, "common_files", 1, 'a "q".php', 0.5),
        ("r", "S", 0, "common_files", 2, "b.php", 0.25),
        ("r", "S", 0, "only_one_model", 1, "c.php", -0.5),
        ("r", "E", 3, None, None, None, None),
        ("q", "S", 0, "only_one_model", 1, "d.php", 1.0),
    ]
    return spark.createDataFrame(table, RESULT)


def test_result_document_is_the_json_object(spark, tmp_path):
    found = {r.repo_id: json.loads(r.document) for r in result_documents(results(spark)).collect()}
    assert found["r"] == {
        "S": {"common_files": [['a "q".php', 0.5], ["b.php", 0.25]], "only_one_model": [["c.php", -0.5]]},
        "E": {"common_files": [], "only_one_model": []},
    }
    assert list(found["r"]) == ["S", "E"]
    out = tmp_path / "out"
    writers.write_result_json(results(spark), str(out), depth=3)
    (file,) = (out / "depth=3" / "repo_id=r").glob("*.txt")
    lines = [json.loads(line) for line in file.read_text().splitlines()]
    assert [list(line) for line in lines] == [["S"], ["E"]]
    assert lines[0]["S"] == found["r"]["S"] | {"first_row": 0, "offset": 0}


def test_large_results_are_read_back_whole(spark, tmp_path):
    many = spark.range(3000).select(
        F.lit("m").alias("repo_id"), F.concat(F.lit("s"), "id").alias("section_name"), F.col("id").alias("first_row"),
        F.lit("common_files").alias("kind"), F.lit(1).cast("long").alias("pos"), F.lit("a.php").alias("file_name"), F.lit(0.5).alias("score"),
    )
    long = spark.range(9000).select(
        F.lit("m").alias("repo_id"), F.lit("long").alias("section_name"), F.lit(5000).cast("long").alias("first_row"),
        F.lit("common_files").alias("kind"), (F.col("id") + 1).alias("pos"), F.concat(F.lit("f"), "id").alias("file_name"), F.lit(0.25).alias("score"),
    )
    writers.write_result_json(many.unionByName(long), str(tmp_path / "out"), by="model")
    found = readers.read_results(spark, str(tmp_path / "out"))
    assert found.where("section_name <> 'long'").select("section_name", "first_row").distinct().count() == 3000
    assert found.where("section_name = 'long' and file_name = concat('f', pos - 1) and first_row = 5000").count() == 9000


def test_text_that_is_not_one_object_raises(spark, tmp_path):
    (tmp_path / "section_result_x.json").write_text('{"S": {"common_files": []}}\n{"T": {"common_files": []}}')
    with pytest.raises(Exception, match="not one JSON object"):
        readers.read_results(spark, str(tmp_path), layout="document").collect()
    (tmp_path / "section_result_x.json").write_text('{\n"S": {"common_files": []}}')
    with pytest.raises(Exception, match="not one JSON object"):
        readers.read_results(spark, str(tmp_path)).collect()


def test_long_lists_come_in_pieces(spark):
    table = spark.range(1, 11).select(F.lit("r").alias("repo_id"), F.lit("S").alias("section_name"), F.lit(0).cast("long").alias("first_row"), F.lit("common_files").alias("kind"), F.col("id").alias("pos"), F.concat(F.lit("f"), "id").alias("file_name"), F.lit(0.5).alias("score"))
    pieces = nest_results(table, pairs=4).orderBy("piece").collect()
    assert [len(p.result.common_files) for p in pieces] == [4, 4, 2]
    assert [f.file_name for p in pieces for f in p.result.common_files] == [f"f{i}" for i in range(1, 11)]


def test_combined_payload(spark):
    tree = spark.range(3).select(F.lit("r").alias("repo_id"), F.col("id").alias("pos"), F.concat(F.lit("f"), "id").alias("path"), F.lit("eA==").alias("content"))
    parts = combined_payload(results(spark), tree, files=2).where("repo_id = 'r'").orderBy("part").collect()
    objects = [json.loads(p.payload) for p in parts]
    assert [list(o["rag_output"]) for o in objects] == [["S", "E"], []]
    assert [list(o["repo_files"]) for o in objects] == [["f0", "f1"], ["f2"]]
    assert objects[0]["repo_files"]["f0"] == {"type": "blob", "encode": "base64", "content": "eA=="}


def test_metrics_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('section_name,TP,FP,TN,FN,precision,recall,f1_score,specificity,balanced_accuracy\n"A, b",0,69,0,0,0.0,,,0.0,\n')
    assert tuple(readers.read_metrics(spark, str(path)).first()) == ("A, b", 0, 69, 0, 0, 0.0, None, None, 0.0, None)


def files(spark, contents, repo="7"):
    return spark.createDataFrame([(repo, i, f"d/f{i}.php", c) for i, c in enumerate(contents)], "repo_id string, pos long, path string, content string")


def test_index_skips_failures_and_replaces_only_its_partitions(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    write_index(build_index(files(spark, ["a b", "", "c"]), MODEL), path)
    write_index(build_index(files(spark, ["x"], "8"), MODEL), path)
    write_index(build_index(files(spark, ["a", "b", "c"]), HashModel("other", 8)), path)
    index = read_index(spark, path)
    assert rows(total_files(index)) == [("7", "m", 2), ("7", "other", 3), ("8", "m", 1)]
    assert rows(index_map(read_index(spark, path, "7", MODEL))) == [("7", "m", 0, "d/f0.php"), ("7", "m", 1, "d/f2.php")]
    plan = read_index(spark, path, "7", MODEL)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo_id" in plan


def test_model_of_another_dimension_raises(spark, tmp_path):
    path = str(tmp_path / "index")
    write_index(build_index(files(spark, ["a"]), MODEL), path)
    with pytest.raises(Exception, match="dimension mismatch"):
        read_index(spark, path, model=HashModel("m", 32)).collect()


def test_build_or_load(spark, rows):
    old = files(spark, ["one", "two", "gone"])
    store = build_or_load(old, None, MODEL)
    new = files(spark, ["one", "changed"])
    fresh = build_or_load(new, store, MODEL)
    expected = embed(new, "content", MODEL).select("path", F.sha2("content", 256), "embedding")
    assert rows(fresh, "path", "digest", "embedding") == rows(expected)
    assert rows(build_or_load(new, store, MODEL, mode="exists")) == rows(store)
