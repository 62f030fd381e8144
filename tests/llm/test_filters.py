import os
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import Row

from traceline.llm import quality_rules, toxicity, url_filter

URLS = [
    ("https://WWW.Example.ORG/es/1?q#f", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://example.org", "example.org", "", None, None),
    ("http://notexample.com/fr/x", "notexample.com", "/fr/x", "com/fr/", "allow"),
    ("http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    ("http://acom/de/", "acom", "/de/", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("x://h?/p#", "h", "", None, None),
]


def test_urls(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages, model).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].p_block >= 0.5 else "allow"))
    assert url_filter.judge(pages.limit(0), model).count() == 0


def test_url_model_generalises(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    urls = ["https://mega-casino.net/x", "https://ads.track.net/", "https://my-garden.net/roses", "https://town-news.net/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages, model).orderBy("page_id").collect()] == ["block"] * 2 + ["allow"] * 2


def brute_statistics(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered.update(range(i, i + 5))
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_statistics_by_brute_force(frame, odd):
    more = frame([(20, "a b c d e a b c d e x"), (21, "l\nl\n \nl\x0b\n"), (22, "q " * 30), (23, "# | <>")])
    docs = odd.unionAll(more)
    got = quality_rules.text_statistics(docs).collect()
    texts = Counter(brute_statistics(r.text) for r in docs.collect())
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts


def test_learned_list_is_precise_and_ordered():
    rows = [
        Row(quality=int(i % 5 != 0), **{f: float(i % 7) for f in quality_rules.FEATURES} | {"symbol_share": 0.5 if i % 5 == 0 else 0.01})
        for i in range(500)
    ]
    rules = quality_rules.learn_rules(rows)
    assert len(rules) == 1 and rules[0][0].feature == "symbol_share" and rules[0][0].above
    assert quality_rules.learn_rules(rows[:10]) == []


def test_quality_stage_keeps_columns(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    kept = quality_rules.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 5]
    assert quality_rules.keep_good(odd.limit(0), labels.limit(0)).count() == 0


@pytest.fixture
def taught(spark, frame):
    plain = [f"the quiet garden {i} has many green trees and a small river" for i in range(120)]
    rude = [f"the quiet garden {i} you stupid worthless idiot of a small river" for i in range(60)]
    docs = frame(list(enumerate(plain + rude)))
    labels = spark.createDataFrame([(i, 1, int(i >= 120)) for i in range(180)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_learns_and_holds_out(taught):
    docs, labels = taught
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == int(r.doc_id >= 120) for r in held)


def test_counting_and_scoring_cut_texts_alike(spark):
    text = "Don't well-known 2024 x1y Über\u00a0all"
    assert toxicity.words_of(text) == ["dont", "wellknown", "", "xy", "über", "all"]
    counts = toxicity.count_ngrams(spark.createDataFrame([(text, 1, False)], "text string, toxic int, late boolean")).toArrow()
    model = toxicity.estimate(counts)
    # Every word was counted, so each is likelier under the toxic class than one that was not.
    known, other = model.words([w for w in toxicity.words_of(text) if w]), model.words(["qqqq"])
    assert min(known) > other[0]


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Python workers that cannot import the package score all the same."""
    program = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from checks.compare import session
from traceline.llm import toxicity
spark = session("2")
docs = spark.createDataFrame([(i, "bad evil words" if i % 3 else "calm plain talk") for i in range(40)], "doc_id long, text string")
labels = docs.selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) as toxic")
print("scored", toxicity.score_documents(docs, toxicity.train(docs, labels)).where("score is not null").count())
"""
    (tmp_path / "run.py").write_text(program)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "scored 40" in run.stdout, run.stderr[-2000:]


def test_toxicity_of_odd_rows(taught, odd):
    docs, labels = taught
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == 10 and all(r.held_out is not None for r in got)
    assert {r.predicted for r in got if r.doc_id in (2, 3, 6)} == {0}
    kept = toxicity.keep_ordinary(odd, labels)
    assert kept.columns == odd.columns
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score_documents(docs.limit(0), empty).count() == 0
    assert {r.predicted for r in toxicity.score_documents(odd, empty).collect()} == {0}
