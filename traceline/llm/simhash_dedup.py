"""Near copies by SimHash and exact tiled comparison.

A fingerprint bit is set when it is set in more than half of the 64-bit hashes
of a text's three-word shingles. Two fingerprints are linked when they differ
in at most ``RADIUS`` bits, and a document's component is all it reaches.

Fingerprints that close agree in at least one of ``RADIUS + 1`` blocks of bits,
so they are compared inside cells, one per block and value. A cell is ordered
by population count and cut into tiles; a pair of tiles is compared by
exclusive-or and bit counts, unless their population counts already differ
beyond the radius. Of the links found only a spanning forest leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.llm.components import components, local_forest
from traceline.llm.texts import slices
from traceline.operators.ranking import number_rows
from traceline.runtime import stored

RADIUS = 3
WORDS = 3  # words of a shingle
SEED = 42
TILE = 2048  # fingerprints in a tile
GROUP = 50_000  # fingerprints of small cells compared by one call

_SEGMENT = 255  # hashes whose bits are added in one byte
_EVERY_EIGHTH = np.uint64(0x0101010101010101)


def shingle_hashes(data: bytes, size: int = WORDS) -> list[int]:
    """XXH64 of each shingle of the text, repeats included; none without words."""
    words = data.lower().split()  # both go by ASCII only
    if not words:
        return []
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return [xxhash.xxh64_intdigest(part, SEED) for part in parts]


def vote(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of hashes; zero for an empty list."""
    out = np.zeros(len(hashes), np.uint64)
    lengths = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    lengths = lengths[full]
    flat = np.fromiter((h for i in full for h in hashes[i]), np.uint64, int(lengths.sum()))
    pieces = -(-lengths // _SEGMENT)
    owner = np.cumsum(pieces) - pieces
    inside = np.arange(pieces.sum()) - np.repeat(owner, pieces)
    starts = np.repeat(np.cumsum(lengths) - lengths, pieces) + inside * _SEGMENT
    for shift in range(8):
        sums = np.add.reduceat((flat >> np.uint64(shift)) & _EVERY_EIGHTH, starts)
        votes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), owner)
        for byte in range(8):
            out[full] |= (2 * votes[:, byte] > lengths).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp``: the fingerprint of every row as a signed long. NULL texts are empty. Narrow."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = vote([shingle_hashes(data or b"") for data in part.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(task, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp bigint")


def _cells(radius: int) -> Column:
    """One cell per block of bits: block number above, value below."""
    bounds = [64 * i // (radius + 1) for i in range(radius + 2)]
    blocks = [
        F.shiftrightunsigned(F.shiftleft("fp", 64 - high), 64 - high + low) + F.lit(i << 32)
        for i, (low, high) in enumerate(zip(bounds, bounds[1:]))
    ]
    return F.explode(F.array(*blocks))


def _forest(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Table:
    node, root = local_forest(len(nodes), left, right)
    return pa.table({"a": nodes[node].view(np.int64), "b": nodes[root].view(np.int64)})


def compare_cells(table: pa.Table, radius: int) -> pa.Table:
    """Links inside many small cells (``cell, fp``), by distance in the order of population counts."""
    fp = table.column("fp").to_numpy().view(np.uint64)
    cell, weight = table.column("cell").to_numpy(), np.bitwise_count(fp).astype(np.int16)
    order = np.lexsort((fp, weight, cell))
    fp, cell, weight = fp[order], cell[order], weight[order]
    nodes, which = np.unique(fp, return_inverse=True)
    left, right = [], []
    at, step = np.arange(len(fp)), 1
    while True:
        at = at[at + step < len(fp)]
        at = at[(cell[at] == cell[at + step]) & (weight[at + step] - weight[at] <= radius)]
        if not len(at):
            break
        close = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        left.append(which[close])
        right.append(which[close + step])
        step += 1
    return _forest(nodes, *(np.concatenate([*side, np.zeros(0, np.int64)]).astype(np.int64) for side in (left, right)))


def compare_tiles(first: np.ndarray, second: np.ndarray, radius: int) -> pa.Table:
    """Links between two tiles of fingerprints (or inside one)."""
    left, right = np.nonzero(np.bitwise_count(first[:, None] ^ second[None, :]) <= radius)
    nodes, which = np.unique(np.concatenate([first, second]), return_inverse=True)
    return _forest(nodes, which[left], which[len(first) + right])


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: links that join all fingerprints within ``radius``, from a written table of distinct ``fp``.

    Cells of at most ``tile`` fingerprints share tasks; larger ones are cut into
    tiles by a range sort, and each pair of tiles is a row of its own.
    """
    cells = distinct.select("fp", _cells(radius).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    sized = stored(cells.join(sizes, "cell"), "cells")
    groups = max(1, sized.count() // GROUP)

    def small(part: pa.Table) -> pa.Table:
        return compare_cells(part, radius)

    near = (
        sized.where(F.col("n") <= tile)
        .select("fp", "cell", F.pmod(F.xxhash64("cell"), F.lit(groups)).alias("_group"))
        .groupBy("_group")
        .applyInArrow(small, "a long, b long")
    )
    big = sized.where(F.col("n") > tile)
    ranked = number_rows(
        big.select("cell", "fp", F.bit_count("fp").alias("weight")), ["cell"], ["weight", "fp"], "rank", start=0
    )
    tiles = stored(
        ranked.groupBy("cell", F.floor(F.col("rank") / tile).alias("tile")).agg(
            F.collect_list("fp").alias("fps"), F.min("weight").alias("low"), F.max("weight").alias("high")
        ),
        "tiles",
    )
    one, two = tiles.alias("one"), tiles.alias("two")
    pairs = one.join(
        two,
        (F.col("one.cell") == F.col("two.cell"))
        & (F.col("one.tile") <= F.col("two.tile"))
        & (F.col("two.low") - F.col("one.high") <= radius),
    ).select(F.col("one.fps").alias("first"), F.col("two.fps").alias("second"))

    def tiled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, second in zip(batch.column(0), batch.column(1)):
                sides = [side.values.to_numpy(zero_copy_only=False).view(np.uint64) for side in (first, second)]
                yield from compare_tiles(*sides, radius).to_batches()

    return near.unionByName(pairs.mapInArrow(tiled, "a long, b long"))


def near_components(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """``key, fp, component_id``: every row with the smallest key of its component.

    Equal fingerprints are brought together first, whatever their number.
    NULL texts and texts without words have the fingerprint zero and are linked
    like any other. A NULL key is never the smallest; a component of NULL keys
    only has a NULL ``component_id``. Repeated rows each give a row.
    """
    prints = stored(fingerprints(docs, key, text), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(key).alias("_first")), "distinct")
    roots = components(links(distinct.select("fp"), radius, tile))
    rooted = stored(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted"
    )
    smallest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_one(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of their component.

    Any other columns stay as they are, whatever their names. Rows that repeat that key stay together; of rows without a key the first
    of a component without any key stays.
    """
    found = near_components(docs.select(key, "text"), radius, key).where(F.col(key).eqNullSafe(F.col("component_id")))
    mark = unused("key", docs)
    kept = found.select(F.col(key).alias(mark)).distinct()
    return docs.join(kept, F.col(key).eqNullSafe(F.col(mark)), "left_semi")
