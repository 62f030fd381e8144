import hashlib
import random
import re

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from traceline.llm import components, fingerprints, html_extract, induced_sort, quality_rules, simhash_dedup, suffix_dedup, toxicity
from traceline.runtime import stored


def brute_removal(rows, length=50):
    least = {}
    for key, text in rows:
        data = (text or "").encode()
        if key is not None:
            for i in range(len(data) - length + 1):
                part = data[i : i + length]
                least[part] = min(least.get(part, key), key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if key is not None and least.get(data[i : i + length], key) < key:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def test_repeats_by_brute_force(odd, frame):
    draw = random.Random(5)
    base = ["".join(draw.choice("ab c") for _ in range(120)) for _ in range(4)]
    rows = [(100 + i, "".join(draw.choice(base)[draw.randrange(40) :] for _ in range(3))) for i in range(30)]
    rows += [(200 + i, "a" * (45 + i)) for i in range(10)]
    docs = odd.unionAll(frame(rows)).repartition(3)
    want = brute_removal([(r.doc_id, r.text) for r in docs.collect()])
    for options in ({}, {"hot": 2, "block": 500}):
        got = suffix_dedup.remove_repeats(docs, carry=["lang"], **options).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == want
    stage = suffix_dedup.dedup_texts(docs)
    assert stage.columns == docs.columns and stage.count() == docs.count()
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_induced_order_in_memory_and_on_disk():
    draw = np.random.default_rng(1)
    for trial in range(40):
        text = draw.integers(0, draw.integers(2, 5), draw.integers(1, 300)).astype(np.uint8)
        text = np.append(np.tile(text, 1 + trial % 3), np.zeros(56, np.uint8))
        order = induced_sort.suffix_order(text, 24, memory=200 if trial % 8 == 0 else induced_sort.MEMORY)
        data = text.tobytes()
        parts = [data[i : i + 24].ljust(24, b"\0") for i in order]
        assert parts == sorted(parts) and sorted(order.tolist()) == list(range(len(text)))
        runs = induced_sort.equal_runs(text, order, 24)
        whole = [i for i in range(1, len(order)) if max(order[i], order[i - 1]) + 24 <= len(text)]
        assert all((runs[i] == runs[i - 1]) == (parts[i] == parts[i - 1]) for i in whole)


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_components_by_brute_force(odd, frame):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    base = [[draw.choice(words) for _ in range(200)] for _ in range(5)]
    rows = []
    for i in range(60):
        text = list(draw.choice(base))
        text[draw.randrange(200)] = draw.choice(words)
        rows.append((100 + i, " ".join(text)))
    docs = odd.unionAll(frame(rows))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    prints = np.array([brute_fingerprint(t) for _, t in texts], np.uint64)
    left, right = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    label = np.arange(len(texts))
    node, root = components.local_forest(len(texts), left, right)
    label[node] = root
    want = []
    for i, (key, _) in enumerate(texts):
        members = [texts[j][0] for j in np.flatnonzero(label == label[i]) if texts[j][0] is not None]
        want.append((key, int(prints[i]), min(members, default=None)))
    for tile in (2048, 4):
        got = simhash_dedup.near_components(docs, tile=tile).collect()
        assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    firsts = {component for _, _, component in want if component is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == firsts
    assert simhash_dedup.near_components(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(links.unionAll(links.limit(3))).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 301)}


def test_edit_report(odd):
    got = fingerprints.edit_report(odd).collect()
    assert len(got) == 10
    rows = sorted({(r.doc_id, r.text or "") for r in odd.collect()}, key=lambda r: -1 if r[0] is None else r[0])
    by_key = {r.doc_id: r for r in got}
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        assert by_key[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_key[key].n_chars == len(text) and 0 <= by_key[key].near_edited <= 1
    assert by_key[2].fp == by_key[3].fp == 0
    assert by_key[4].near_edited > by_key[4].near_next
    assert fingerprints.edit_report(odd.limit(0)).count() == 0
    alone = fingerprints.edit_report(odd.where("doc_id = 1")).first()
    assert alone.near_next == 1


def test_native_votes_by_brute_force(spark):
    docs = spark.createDataFrame([(1, "a bb a bb"), (2, "solo"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.fp_text for r in fingerprints.fingerprint(docs, ["doc_id"], ["text"]).collect()}
    hashed = spark.range(1).select(F.xxhash64(F.lit("a"), F.lit("bb")).alias("x"), F.xxhash64(F.lit("bb"), F.lit("a")).alias("y")).first()
    votes = [(hashed.x, 1), (hashed.y, 1), (hashed.x, 1)]
    want = sum(1 << b for b in range(64) if 2 * sum(w for h, w in votes if h >> b & 1) > 3)
    assert got[1] % 2**64 == want and got[3] == 0


def test_all_pairs_within_the_radius(spark):
    draw = random.Random(7)
    prints = [draw.getrandbits(64) for _ in range(20)]
    for p in list(prints):
        for _ in range(3):
            for _ in range(draw.randrange(1, 6)):
                p ^= 1 << draw.randrange(64)
            prints.append(p)
    signed = sorted({p - 2**64 if p >> 63 else p for p in prints})
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    rows = spark.createDataFrame([(p,) for p in signed + signed[:3]] + [(None,)], "fp long")
    assert {(r.a, r.b) for r in fingerprints.within_radius(rows).collect()} == want


PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li>Home<li>About</ul></nav>"
    "<div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p>One <b>two</b>\n three<br>four<p>five"
    "<div class=\"comments\"><p>nice</p></div><form>mail</form></article><footer>&copy; us</footer>"
)


def test_main_text_by_structure():
    assert html_extract.main_texts([html_extract.page_blocks(PAGE)]) == ["Title & more One two three four five"]
    assert html_extract.page_blocks("") == [] and html_extract.page_blocks("plain <b>text") == [(html_extract.OPEN, "plain text")]
    assert html_extract.main_texts([html_extract.page_blocks("<p>a<!-- gone <p>b")]) == ["a"]


def test_names_hide_no_article():
    text = "<p>The whole story of the day.</p>"
    for page in (
        f'<body class="single-post no-sidebar comments-open">{text}</body>',
        f'<html class="menu"><body id="search">{text}</body></html>',
        f'<article class="post ad" data-id="ad-17">{text}</article>',
        f'<div data-id="ad" data-role=banner title=\'x class="ad"\'>{text}</div>',
        f'<div class="no-sidebar has-banner"><main role="main" class="search">{text}</main></div>',
        f'<div class="widget"><div><article>{text}</article></div><p>Buy</p></div>',
        f'<div class="search"><article>{text}<ul class="comments"><article>First!</article></ul></article></div>',
        f'<main>{text}</main><div class="related"><article>Another story</article></div>',
        f'<article>{text}<div class="comments"><article><p>First!</p></article></div></article>',
    ):
        assert html_extract.main_texts([html_extract.page_blocks(page)]) == ["The whole story of the day."], page
    aside = "<div class='box AD wide'><p>Buy</p></div><div role=banner>Top</div><nav><article>Menu</article></nav>"
    assert html_extract.main_texts([html_extract.page_blocks(aside + text)]) == ["The whole story of the day."]


def test_runs_of_a_host_are_boilerplate(spark):
    same = "our shop sells good things at fair prices every single day of the week"
    pages = [(i, "http://h.test/x", f"<body><div>{same}</div><div>story number {i} tells of w{i} x{i} y{i} z{i}</div></body>") for i in range(12)]
    pages += [(90, None, None), (91, "odd", ""), (91, "odd", "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    for chunk in (html_extract.CHUNK, 10**9):
        got = html_extract.extract(table, chunk=chunk).collect()
        assert len(got) == 15
        for r in got:
            want = f"story number {r.page_id} tells of w{r.page_id} x{r.page_id} y{r.page_id} z{r.page_id}" if r.page_id < 90 else ""
            assert (r.text, r.n_chars) == (want, len(want))
    assert html_extract.extract(table.limit(0)).count() == 0


def test_runs_are_counted_over_the_whole_host(spark):
    banner = "this banner is shown on some of the pages of a host that is hot"
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(25))
    rows = [(i, "http://hot.test/x", f"<body><p>{own(i)}{' ' + banner if i % 8 == 0 else ''}</p></body>") for i in range(80)]
    rows += [(100 + i, "http://same.test/x", f"<body><p>{own(0)} {banner}</p></body>") for i in range(12)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for chunk in (1000, 10**9):
        got = {r.page_id: r.text for r in html_extract.extract(table, chunk=chunk).collect()}
        assert got == {i: own(i) for i in range(80)} | {100 + i: f"{own(0)} {banner}" for i in range(12)}


def test_blocks_of_pages_are_moved_once(spark):
    """Hosts in many chunks give what one suffix array gives, with copies, and pages with and without an article."""
    draw = random.Random(11)
    shared = [" ".join(draw.choice("abcdefghij") * 3 for _ in range(14)) for _ in range(6)]

    def page(i, marked):
        parts = [f"<p>{' '.join(f'w{i}x{j}' for j in range(12))}</p>"] + [f"<p>{draw.choice(shared)}</p>" for _ in range(3)]
        end = f"<p>{shared[0]}</p>" if i % 12 else ""
        return f"<body><nav>{shared[1]}</nav>{'<article>' if marked else ''}{''.join(parts)}{end}{'</article>' if marked else ''}</body>"

    rows = [(i, f"http://{host}/{i}", page(i, host == "marked" or host == "mixed" and i % 3)) for host in ("marked", "mixed", "open") for i in range(70)]
    rows += draw.choices(rows, k=60) + [(None, "http://open/", None), (None, "http://marked/", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = []
    for host in ("marked", "mixed", "open"):
        mine = [r for r in rows if f"//{host}/" in r[1]]
        want += zip(mine, html_extract.main_texts([html_extract.page_blocks(r[2] or "") for r in mine]))
    want = sorted(((r[0], r[1], text, len(text)) for r, text in want), key=repr)
    for chunk in (700, 6000, 10**9):
        found = html_extract.extract(table, chunk=chunk)
        assert sorted(map(tuple, found.collect()), key=repr) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan[plan.index("Initial Plan") :].splitlines() if "Exchange hashpartitioning" in line]
    # The pages (twice the same exchange), the runs and the totals; nothing is joined back.
    assert len(moved) == 4 and "SortMergeJoin" not in plan, plan


def test_pages_of_runs_by_brute_force():
    draw = np.random.default_rng(8)
    for size, letters in ((0, 1), (5, 2), (60, 1), (400, 2), (400, 5)):
        tokens, page = draw.integers(0, letters, size), np.sort(draw.integers(0, 12, size))
        found = {}
        for i in range(size - 3):
            if page[i] == page[i + 3]:
                found.setdefault(tuple(tokens[i : i + 4]), set()).add(page[i])
        want = [len(found.get(tuple(tokens[i : i + 4]), ())) if i + 3 < size and page[i] == page[i + 3] else 0 for i in range(size)]
        assert html_extract.run_pages(tokens, page, 4).tolist() == want
        for least in (3, 8.5):
            some = html_extract.run_pages(tokens, page, 4, least)
            assert all(a == b if b >= least else a in (0, b) for a, b in zip(some.tolist(), want))


def test_packed_runs_come_back():
    draw = np.random.default_rng(2)
    for size in (0, 1, 1000):
        numbers = np.unique(draw.integers(0, 2**64, size, np.uint64, endpoint=False))
        assert (html_extract.unpacked(html_extract.packed(numbers)) == numbers).all()
        assert (html_extract.unpacked_counts(html_extract.packed_counts(numbers >> np.uint64(40))) == numbers >> np.uint64(40)).all()


def brute_shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)] if words else [])


def test_near_dedup_stage_keeps_the_least_of_each_group(spark, odd):
    """The pipeline's stage is the operator with its contract; columns of any name stay."""
    rows = odd.collect()
    more = [(20 + i, "word " * 40 + f"tail{i} of the text") for i in range(6)] + [(40, "something else entirely " * 9)]
    table = [(r.doc_id, r.text, "k", 1, "m") for r in rows] + [(i, t, "k", 1, "m") for i, t in more]
    docs = spark.createDataFrame(table, "doc_id long, text string, _key string, key int, fp string")
    found = simhash_dedup.near_components(docs).collect()
    want = sorted((r.doc_id for r in found if r.doc_id == r.component_id), key=repr)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_text_dedup_keeps_columns_of_any_name(spark):
    shared = "this passage is well over fifty bytes long and is found twice here"
    docs = spark.createDataFrame([(1, shared, "a", 5, 6), (2, "x" + shared, "b", 7, 8)], "doc_id long, text string, _one string, c0 int, _rest int")
    assert sorted(map(tuple, suffix_dedup.dedup_texts(docs).collect())) == [(1, shared, "a", 5, 6), (2, "x", "b", 7, 8)]


def test_pipeline_stage_by_stage(spark):
    """``run`` on given tables: every stage's rows follow from those of the one before, by brute force where that is possible."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    after, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(stage(spark, now, sf), "stage")
        assert now.columns == docs.columns
        after.append({r.doc_id: r.text for r in now.collect()})
    ordinary, good, single, cut = after
    scores = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert set(ordinary) == {r.doc_id for r in scores if not r.predicted}
    left = docs.where(F.col("doc_id").isin(list(ordinary)))
    rules = quality_rules.train(left, labels)
    assert set(good) == {r.doc_id for r in quality_rules.judge(left.select("doc_id", "text"), rules).collect() if r.kept}
    prints = {r.doc_id: r for r in simhash_dedup.near_components(left.where(F.col("doc_id").isin(list(good)))).collect()}
    assert set(single) == {i for i, r in prints.items() if r.component_id == i}
    kept = {i: data for i, _, _, _, data in brute_removal(list(single.items()))}
    assert {i: t for i, t in cut.items()} == {i: data.decode("utf-8", "ignore") for i, data in kept.items()}
    assert all(single[i] == given[i] for i in single)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(cut)
    for i, rows in pieces.items():
        ids = [*tokenizer.encode(cut[i], add_special_tokens=False).ids, 1]
        rows.sort(key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4").tolist() == ids and sum(r.length for r in rows) == len(ids)
    places = {}
    for r in (r for rows in pieces.values() for r in rows):
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:j]) for j in range(len(spans))] and sum(n for _, n in spans) <= 2048
