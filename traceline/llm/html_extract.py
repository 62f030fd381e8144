"""Main text of web pages: structure, and a suffix array over the pages of a host.

A page is cut into blocks of text. Blocks inside menus, headers, footers, side
columns, forms, notices, adverts and comments are known by their elements;
where a page marks its article, what lies outside it goes as well. For what
structure leaves open, the token streams of a host's pages are concatenated and
their suffixes sorted: runs of ``RUN`` tokens that many distinct pages share are
boilerplate, the tokens they cover are removed and unique runs stay. Inside a marked
article a block only goes when nearly every page of the host has it, so
articles that were copied to a few pages stay whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceline.llm.texts import slices
from traceline.runtime import stored

RUN = 8  # tokens of a run, block ends included
CHUNK = 8 * 2**20  # characters of HTML whose pages share a suffix array
PAGES = 3  # distinct pages that make a run boilerplate, whatever the size of the host
EVERYWHERE = 0.8  # share of pages from which a block inside an article is boilerplate
ENOUGH = 8  # pages needed for that
CHUNKS_MERGED = 4  # chunks whose runs are added up at once

# Elements and whole tokens of their class, id or role.
HIDDEN = {"script", "style", "noscript", "template", "head", "svg", "iframe", "object", "select", "textarea", "button", "title"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
MARKED = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
    "consent", "notice", "alert", "popup", "modal", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header",
    "footer", "sidebar", "aside", "widget", "comment", "comments", "reply", "replies", "disqus", "share", "social", "related",
    "newsletter", "subscribe", "login", "search", "pagination", "complementary", "contentinfo",
}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
# Every attribute is read whole, so neither data-id nor a value that spells class="..." counts.
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMED = {"class", "id", "role"}
WHOLE = {"html", "body", "article", "main"}  # never marked by their names

CORE, OPEN, SIDE = 0, 1, 2
# While parsing: beside the text by names only, and an article in there. That is open text, which a
# page's own article outweighs; a <main> in there is the page's article.
NAMED_SIDE, REOPENED = 3, 4
_SHOWN = {CORE: CORE, OPEN: OPEN, SIDE: SIDE, NAMED_SIDE: SIDE, REOPENED: OPEN}


def _is_marked(attributes: str) -> bool:
    """A whole token of class, id or role is one of the words."""
    return any(
        name.lower() in NAMED and not MARKED.isdisjoint("".join(values).lower().split())
        for name, *values in _ATTRIBUTE.findall(attributes)
    )


def page_blocks(page: str) -> list[tuple[int, str]]:
    """``(kind, text)`` of the blocks of a page in order, white space settled, without empty ones.

    Elements may be left open or closed in the wrong order; a closing tag ends
    what is open inside its element, and one without an opening is ignored.
    """
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # element and kind of what is inside; -1 hides
    parts: list[str] = []
    kind, at = OPEN, 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and kind >= 0:
                blocks.append((_SHOWN[kind], text))
            parts.clear()

    for tag in _MARKUP.finditer(page):
        parts.append(page[at : tag.start()])
        at = tag.end()
        if tag.group(3) is None:
            if tag.group(1):
                flush()
            continue
        closing, name = tag.group(2), tag.group(3).lower()
        if name not in INLINE:
            flush()
        if closing:
            if any(name == element for element, _ in stack):
                flush_needed = kind
                while stack.pop()[0] != name:
                    pass
                inner = stack[-1][1] if stack else OPEN
                if inner != flush_needed:
                    flush()
                kind = inner
            continue
        if name in VOID or tag.group(4).endswith("/"):
            continue
        if name not in INLINE and stack and stack[-1][0] in ("p", "li", "dt", "dd") and (stack[-1][0] == "p" or stack[-1][0] == name):
            stack.pop()
            kind = stack[-1][1] if stack else OPEN
        inner = kind
        if name in HIDDEN:
            inner = -1
        elif kind != -1:
            if kind == SIDE or name in ASIDE:
                inner = SIDE
            elif name in MAIN:
                inner = REOPENED if kind in (NAMED_SIDE, REOPENED) and name == "article" else CORE
            elif kind == NAMED_SIDE or name not in WHOLE and _is_marked(tag.group(4)):
                # Inside a marked article nothing reopens: an <article> of its comments is one of them.
                inner = SIDE if kind in (CORE, REOPENED) else NAMED_SIDE
        if inner != kind:
            flush()
        stack.append((name, inner))
        kind = inner
    parts.append(page[at:])
    flush()
    return blocks


def run_pages(tokens: np.ndarray, page: np.ndarray, length: int = RUN, least: float = 1) -> np.ndarray:
    """For each position, the distinct pages that hold the ``length`` tokens from there on (0 at a page's end).

    The suffix order to ``length`` tokens comes from doubling ranks. Runs of
    fewer than ``least`` pages may be left at 0: one with a token that fewer
    pages have is not sorted. ``page`` never falls.
    """
    size = len(tokens)
    out = np.zeros(size, np.int64)
    if size < length:
        return out
    inside = np.zeros(size, bool)
    inside[: size - length + 1] = page[: size - length + 1] == page[length - 1 :]

    def counted(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each key, and the pages that have it at one of the places ``at``."""
        order = np.argsort(keys, kind="stable")
        new = np.append(True, keys[order[1:]] != keys[order[:-1]])
        other = new | np.append(True, page[at[order[1:]]] != page[at[order[:-1]]])
        names = np.cumsum(new) - 1
        rank = np.empty(len(keys), np.int64)
        rank[order] = names
        return rank, np.add.reduceat(other.astype(np.int64), np.flatnonzero(new))[rank]

    rank, pages = counted(tokens, np.arange(size))
    rare = np.concatenate([[0], np.cumsum(pages < least)])
    inside[: size - length + 1] &= rare[length:] == rare[: size - length + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return out
    edges = np.zeros(size + 1, np.int64)
    edges[at] += 1
    edges[at + length] -= 1
    asked = np.flatnonzero(np.cumsum(edges[:-1]))
    width = 1
    while width < length:
        step = min(width, length - width)
        after = rank[np.minimum(asked + step, size - 1)]
        names = np.unique(rank[asked] * size + after, return_inverse=True)[1]
        rank = np.zeros(size, np.int64)
        rank[asked] = names
        width += step
    out[at] = counted(rank[at], at)[1]
    return out


Pages = list[list[tuple[int, str]]]


class Stream:
    """The tokens of distinct pages with their runs."""

    def __init__(self, pages: Pages):
        self.blocks = [(page, kind, text.split()) for page, found in enumerate(pages) for kind, text in found]
        flat: list[str] = []
        for _, _, words in self.blocks:
            flat += words
            flat.append("")  # the end of a block, number 0
        numbers = {word: i for i, word in enumerate(dict.fromkeys(["", *flat]))}
        self.words = list(numbers)
        self.size, self.distinct = len(flat), len(pages)
        self.pages = len(pages)  # of the host
        self.tokens = np.fromiter(map(numbers.__getitem__, flat), np.int64, self.size)
        sizes = np.array([len(words) + 1 for _, _, words in self.blocks], np.int64)
        self.block_at = np.repeat(np.arange(len(self.blocks)), sizes)
        self.page_at = np.repeat(np.array([page for page, _, _ in self.blocks], np.int64), sizes)
        self.has_core = {page for page, kind, _ in self.blocks if kind == CORE}
        self.open = any(kind == OPEN and page not in self.has_core for page, kind, _ in self.blocks)
        self.counts = np.zeros(self.size, np.int64)

    def always(self) -> float:
        """Pages from which a block inside an article is boilerplate."""
        return max(ENOUGH, EVERYWHERE * self.pages)

    def count(self, least: float | None = None) -> None:
        """Set ``counts``: distinct pages that hold the run from each place on.

        It is 0 where none fits, and may be where fewer than ``least`` pages
        have it, by default those that decide nothing.
        """
        least = (PAGES if self.open else self.always()) if least is None else least
        self.counts = run_pages(self.tokens, self.page_at, least=least) if self.distinct >= least else self.counts

    def named(self, at: np.ndarray) -> np.ndarray:
        """The hash of the run from each of the places on."""
        wanted = np.zeros(len(self.words), bool)
        for i in range(RUN):
            wanted[self.tokens[at + i]] = True
        wanted[0] = False
        hashes = np.zeros(len(self.words), np.uint64)
        for word in np.flatnonzero(wanted).tolist():
            hashes[word] = xxhash.xxh64_intdigest(self.words[word].encode("utf-8", "surrogatepass"))
        runs = np.zeros(len(at), np.uint64)
        for i in range(RUN):
            runs = (runs ^ hashes[self.tokens[at + i]]) * np.uint64(0x9E3779B97F4A7C15)
            runs ^= runs >> np.uint64(29)
        return runs

    def emitted(self) -> tuple[np.ndarray, np.ndarray]:
        """Every distinct counted run as a hash, with its pages."""
        at = np.flatnonzero(self.counts)
        runs, first = np.unique(self.named(at), return_index=True)
        return runs, self.counts[at[first]]

    def under(self, least: float) -> np.ndarray:
        """Whether a token lies under a run of at least ``least`` pages.

        A run over several blocks covers only those it holds whole, so the first
        words after a shared block are not taken with it.
        """
        change = np.zeros(self.size + 1, np.int64)
        low = np.flatnonzero(self.counts >= least)
        if not len(low):
            return change[:-1] > 0
        high = low + RUN
        begins = np.searchsorted(self.block_at, np.arange(len(self.blocks)))
        ends = np.append(begins[1:], self.size)
        left, right = self.block_at[low], self.block_at[high - 1]
        crosses = left != right
        cut = crosses & (high < ends[right] - 1)
        high = np.where(cut, begins[right], high)
        low = np.where(crosses & (low > begins[left]), ends[left], low)
        some = low < high
        np.add.at(change, low[some], 1)
        np.add.at(change, high[some], -1)
        return np.cumsum(change[:-1]) > 0

    def texts(self) -> list[str]:
        """The main text of each page."""
        often = self.under(PAGES) if self.open else None
        always = self.under(self.always())
        out: list[list[str]] = [[] for _ in range(self.distinct)]
        at = 0
        for page, kind, words in self.blocks:
            end = at + len(words)
            if kind == CORE and not always[at:end].all():
                out[page] += words
            elif kind == OPEN and page not in self.has_core:
                out[page] += [word for word, gone in zip(words, often[at:end]) if not gone]
            at = end + 1
        return [" ".join(words) for words in out]


def main_texts(pages: Pages) -> list[str]:
    """The main text of each page of a host; equal pages count once."""
    places: dict[tuple, int] = {}
    which = [places.setdefault(tuple(page), len(places)) for page in pages]
    found = Stream(list(map(list, places)))
    found.count()
    texts = found.texts()
    return [texts[i] for i in which]


def packed(numbers: np.ndarray) -> bytes:
    """Rising unsigned 64-bit numbers as compressed planes of the bytes of their steps."""
    steps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    return zlib.compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)


def least_share(pages: int) -> float:
    """Pages of a chunk that hold a run which ``EVERYWHERE`` of its host's pages hold.

    Chunks are dealt by the digest of a page, so by Hoeffding's bound fewer come
    with a probability of e**-64 a run.
    """
    return EVERYWHERE * pages - (32 * pages) ** 0.5


def large_hosts(pages: DataFrame, chunk: int) -> DataFrame:
    """``_host, _chunks, _open`` of the hosts of more than ``chunk`` characters; ``_open``: some page marks no article."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 200):
            found: dict[str, bool] = {}
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found[host] = found.get(host, False) or lacks_article(page_blocks(page or ""))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.bool_())], names=["_host", "_open"])

    chunks = F.ceil(F.sum(F.length("_html").cast("long")) / chunk).cast("long").alias("_chunks")
    # At most one row for every ``chunk`` characters of all pages.
    large = stored(pages.groupBy("_host").agg(chunks).where(F.col("_chunks") > 1), "hosts")
    theirs = pages.join(F.broadcast(large.select("_host")), "_host").select("_host", "_html")
    found = theirs.mapInArrow(opened, "_host string, _open boolean").groupBy("_host").agg(F.max("_open").alias("_open"))
    return stored(found.join(F.broadcast(large), "_host").select("_host", "_chunks", "_open"), "hosts")


def lacks_article(blocks: list[tuple[int, str]]) -> bool:
    """Open text and no article: what other pages share decides what stays."""
    kinds = {kind for kind, _ in blocks}
    return OPEN in kinds and CORE not in kinds


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK) -> DataFrame:
    """``key, url, text, n_chars`` of every page.

    A NULL page is empty and has an empty text; a NULL or odd URL belongs to
    the host without a name. Equal pages of a host count once.
    A host of more than ``chunk`` characters is dealt by content to several
    suffix arrays, whose counts of a run are added up over the host, so the
    result does not depend on ``chunk``. Keys may be NULL or repeat.

    The blocks of a page are moved once, with the keys of equal pages beside
    them. Runs are moved as compressed steps between their sorted hashes; where
    every page of a host marks its article only runs that may be on
    ``EVERYWHERE`` of the pages are.
    """
    slot = ["_host", "_chunk"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 200):
            places: dict[tuple, int] = {}
            members: list[list[int]] = []
            rows: list[tuple] = []
            hosts, chunks, opens = (part.column(i).to_pylist() for i in (3, 4, 5))
            for i, page in enumerate(part.column(2).to_pylist()):
                blocks = json.dumps(page_blocks(page or "")).encode()
                content = hashlib.md5(blocks).digest()
                at = places.setdefault((hosts[i], content), len(rows))
                if at == len(rows):
                    where = int.from_bytes(content[:8], "little") % chunks[i]
                    rows.append((hosts[i], where, chunks[i], opens[i], content, zlib.compress(blocks, 4)))
                    members.append([])
                members[at].append(i)
            order = pa.array([i for same in members for i in same], pa.int64())
            ends = pa.array(np.cumsum([0, *map(len, members)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, part.column(i).take(order)) for i in (0, 1)]
            values = zip(*rows) if rows else [()] * 6
            columns = [pa.array(v, kind) for v, kind in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, *lists], names=[*slot, "_chunks", "_open", "_content", "_blocks", "_keys", "_urls"])

    def stream(table: pa.Table) -> tuple[Stream, list[int]]:
        """The distinct pages, and which of them each row is."""
        places: dict[bytes, int] = {}
        which = [places.setdefault(content, len(places)) for content in table.column("_content").to_pylist()]
        first = np.unique(which, return_index=True)[1]
        blocks = table.column("_blocks").take(pa.array(first)).to_pylist()
        return Stream([json.loads(zlib.decompress(b)) for b in blocks]), which

    counted = pa.schema(
        [("_host", pa.string()), ("_bucket", pa.int64()), ("_chunk", pa.int64()), ("_pages", pa.int64()), ("_runs", pa.binary()), ("_n", pa.binary())]
    )

    def count(table: pa.Table) -> pa.Table:
        """The runs of a chunk, cut by hash to buckets; bucket 0 always has the chunk's pages."""
        host, here, chunks, open_ = (table.column(name)[0].as_py() for name in (*slot, "_chunks", "_open"))
        if chunks == 1:
            return counted.empty_table()
        found, _ = stream(table)
        found.count(1 if open_ else least_share(found.pages))
        runs, counts = found.emitted()
        buckets = -(-chunks // CHUNKS_MERGED) if open_ else 1
        bounds = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
        cuts = [*np.searchsorted(runs, bounds).tolist(), len(runs)]
        rows = [
            (host, i, here, found.pages if i == 0 else 0, packed(runs[a:b]), packed_counts(counts[a:b]))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
            if a < b or i == 0
        ]
        return pa.Table.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows), counted.types)], schema=counted)

    def add(table: pa.Table) -> pa.Table:
        """To every chunk the totals of its runs, where they matter and are not its own counts."""
        runs = [unpacked(r) for r in table.column("_runs").to_pylist()]
        counts = [unpacked_counts(n) for n in table.column("_n").to_pylist()]
        names, place = np.unique(np.concatenate(runs), return_inverse=True)
        totals = np.zeros(len(names), np.int64)
        np.add.at(totals, place, np.concatenate(counts))
        starts = np.cumsum([0, *map(len, runs)])
        told = []
        for a, b, own, n in zip(starts, starts[1:], runs, counts):
            total = totals[place[a:b]]
            news = (total >= PAGES) & (total > n)
            told.append((packed(own[news]), packed_counts(total[news])))
        whole = sum(table.column("_pages").to_pylist())
        columns = [table.column(name).combine_chunks() for name in ("_host", "_bucket", "_chunk")]
        columns += [pa.array([whole] * len(told), pa.int64()), *(pa.array(v, pa.binary()) for v in zip(*told))]
        return pa.Table.from_arrays(columns, schema=counted)

    def cut(table: pa.Table, totals: pa.Table) -> pa.Table:
        found, which = stream(table)
        if not totals.num_rows:
            found.count()
        else:
            found.count(1 if table.column("_open")[0].as_py() else least_share(found.pages))
            found.pages = sum(totals.column("_pages").to_pylist())
            names = np.concatenate([unpacked(r) for r in totals.column("_runs").to_pylist()])
            total = np.concatenate([unpacked_counts(n) for n in totals.column("_n").to_pylist()])
            if len(names):
                order = np.argsort(names)
                names, total = names[order], total[order]
                at = np.flatnonzero(found.counts)
                runs = found.named(at)
                place = np.minimum(np.searchsorted(names, runs), len(names) - 1)
                found.counts[at] = np.where(names[place] == runs, total[place], found.counts[at])
        texts = pa.array(found.texts(), pa.string()).take(pa.array(which))
        return pa.table([table.column("_keys"), table.column("_urls"), texts], names=["_keys", "_urls", "text"])

    kind = pages.schema[key].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))
    hosted = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"), host.alias("_host"))
    sized = hosted.join(F.broadcast(large_hosts(hosted, chunk)), "_host", "left").select(
        "_key", "_url", "_html", "_host", F.coalesce("_chunks", F.lit(1)).alias("_chunks"), F.coalesce("_open", F.lit(True)).alias("_open")
    )
    fields = f"_keys array<{kind}>, _urls array<string>"
    parsed = sized.mapInArrow(parse, f"_host string, _chunk long, _chunks long, _open boolean, _content binary, _blocks binary, {fields}")
    form = "_host string, _bucket long, _chunk long, _pages long, _runs binary, _n binary"
    runs = parsed.groupBy(*slot).applyInArrow(count, form)
    totals = runs.groupBy("_host", "_bucket").applyInArrow(add, form)
    found = parsed.groupBy(*slot).cogroup(totals.groupBy(*slot)).applyInArrow(cut, f"{fields}, text string")
    rows = found.select(F.explode(F.arrays_zip("_keys", "_urls")).alias("_row"), "text")
    return rows.select(F.col("_row._keys").alias(key), F.col("_row._urls").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
