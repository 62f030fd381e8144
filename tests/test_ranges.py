"""JSON objects read in ranges, whatever the ranges cut through."""

import json
import random

import pytest

from traceline.sources.json_object import cut_entries, range_ends, read_json_entries
from traceline.sources.readers import read_repo_tree

TRICKY = {
    "plain": {"type": "blob", "content": "QUJD"},
    'quote " and \\ back': "text with \"quotes\", {braces}: [and] more",
    "ends in \\": "\\\\",
    "ünïcödé 😀 \u0001": ["a", {"deep": {"er": ["]", "}", "\\\""]}}, None, 1.5e3, True],
    "": "",
    "empty": {},
    "list": [],
    "number": -12,
    "nested": {"key": {"key": {"key": ","}}},
}
LAYOUTS = [dict(), dict(indent=3), dict(separators=(",", ":"), ensure_ascii=False), dict(indent="\t", ensure_ascii=False)]


def in_ranges(data, size):
    """The two passes without Spark."""
    pieces = [data[i : i + size] for i in range(0, len(data), size)]
    state, depth, out = 0, 0, []
    for i, piece in enumerate(pieces):
        more = 1
        while (found := cut_entries(data[i * size : i * size + len(piece) + more], len(piece), state, depth, i * size + len(piece) + more >= len(data))) is None:
            more *= 2
        out += [(i * size + at, json.loads(k), json.loads(v)) for at, k, v in found]
        end = range_ends(piece)[state]
        state, depth = end[0], depth + end[1]
    assert (state, depth) == (0, 0)
    return out


@pytest.mark.parametrize("layout", LAYOUTS)
def test_every_cut_gives_the_same_entries(layout):
    data = json.dumps(TRICKY, **layout).encode()
    for size in range(1, len(data) + 1):
        found = in_ranges(data, size)
        assert [(k, v) for _, k, v in found] == list(TRICKY.items())
        assert all(data[at : at + 1] == b'"' for at, *_ in found)


def test_random_objects():
    draw = random.Random(4)

    def value(level):
        kind = draw.randrange(6 if level < 3 else 3)
        if kind < 3:
            return "".join(draw.choices('ab\\"{}[]:, \né', k=draw.randrange(9)))
        if kind < 4:
            return draw.choice([None, True, 0, -1.5])
        return [value(level + 1) for _ in range(draw.randrange(3))] if kind < 5 else {str(draw.random()): value(level + 1) for _ in range(draw.randrange(3))}

    for _ in range(60):
        given = {f"{i}" + "".join(draw.choices('\\"x:', k=3)): value(0) for i in range(draw.randrange(6))}
        data = json.dumps(given, indent=draw.choice([None, 1])).encode()
        for size in (1, 2, 3, 5, 11, 1000):
            assert [(k, v) for _, k, v in in_ranges(data, size)] == list(given.items())


def test_files_in_ranges_equal_whole_files(spark, rows, tmp_path):
    blob = lambda t: {"type": "blob", "encode": "base64", "content": t}
    for repo, tree in (("one", {f"d/f{i}.py": blob("QUJD" * i) for i in range(30)}), ("two", {"a": blob(""), "b": blob(None)}), ("none", {})):
        folder = tmp_path / f"repo_id={repo}" / "part=0"
        folder.mkdir(parents=True)
        (folder / "t.json").write_text(json.dumps(tree, indent=1))
    whole = rows(read_repo_tree(spark, f"{tmp_path}/*/*"), "repo_id", "path", "content")
    for size in (50, 10**6):
        found = read_repo_tree(spark, f"{tmp_path}/*/*", range_bytes=size)
        assert rows(found, "repo_id", "path", "content") == whole
        assert [r.path for r in found.where("repo_id = 'one'").orderBy("pos").collect()] == [f"d/f{i}.py" for i in range(30)]


def test_repeated_names_and_broken_files(spark, rows, tmp_path):
    (tmp_path / "twice.json").write_text('{"a": {"content": "1"}, "b": {"content": "2"}, "a": {"content": "3"}}')
    found = read_repo_tree(spark, str(tmp_path), "r", range_bytes=16).orderBy("pos")
    assert [(r.path, r.content) for r in found.collect()] == [("a", "3"), ("b", "2")]
    for text in ('{"a": 1', '{"a": "x}', "[1, 2]", '"text"'):
        (tmp_path / "twice.json").write_text(text)
        with pytest.raises(Exception, match="JSON object"):
            read_json_entries(spark, str(tmp_path), 4).collect()


def test_ranges_are_dealt_to_many_tasks_and_read_little_beyond_them(spark, tmp_path, monkeypatch):
    """The rows of ranges are tiny, so that by their size alone one task would get them all."""
    tree = {f"f{i}": {"content": "QUJD" * 20} for i in range(400)}
    (tmp_path / "t.json").write_text(json.dumps(tree))
    found = read_json_entries(spark, str(tmp_path), 256).selectExpr("key", "spark_partition_id() as task").collect()
    assert sorted(r.key for r in found) == sorted(tree) and len({r.task for r in found}) > 4
