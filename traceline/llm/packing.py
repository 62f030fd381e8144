"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and a rest. Rests are counted by
length class; a linear program over patterns (how many rests of each class
share a sequence) is solved by column generation, where a knapsack by dynamic
programming finds the pattern worth most at the current prices. Patterns are
used a whole number of times, what that leaves over is filled greedily, and
rests take their places by their rank within the class.

Only the histogram (at most ``capacity / GRAIN`` rows) reaches the driver, and
the plan made from it is bounded by the number of classes, not by the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceline.llm.texts import WORD_ROWS, slices, strings
from traceline.llm.tokens import tokenizer
from traceline.operators.ranking import number_rows
from traceline.runtime import stored

CAPACITY = 2048
GRAIN = 8  # ids per length class: a rest is planned as if up to GRAIN - 1 longer
ROUNDS = 6000  # columns generated at most; any basis on the way is a valid plan
END = 1


def cut_documents(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end: int = END,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens`` and ``ids``: pieces of at most ``capacity`` ids.

    Each text (NULL: empty) is encoded by the tokenizer file and ends with the
    id ``end``, so every row has a piece, an empty one of a single id. A longer
    document is cut into full pieces and a rest. Rows are independent: keys may
    be NULL or repeat. Narrow.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = tokenizer(path), end.to_bytes(4, "little")
        for part in slices(batches, WORD_ROWS):
            rows, starts, pieces, sizes = [], [], [], []
            for row, ids in enumerate(coder.encode_batch(strings(part.column(1)))):
                ids += last
                for start in range(0, len(ids), 4 * capacity):
                    rows.append(row)
                    starts.append(start // 4)
                    pieces.append(ids[start : start + 4 * capacity])
                    sizes.append(len(ids) // 4)
            columns = [
                part.column(0).take(pa.array(rows, pa.int64())),
                pa.array(starts, pa.int64()),
                pa.array([len(p) // 4 for p in pieces], pa.int64()),
                pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                pa.array(sizes, pa.int64()),
            ] + ([pa.array(pieces, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else [])
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select(key, text).mapInArrow(task, schema + (", ids binary" if with_ids else ""))


def best_pattern(prices: np.ndarray) -> tuple[float, np.ndarray]:
    """Worth and class counts of the pattern worth most; class ``c`` takes ``c`` units."""
    units = len(prices) - 1
    prices = np.where(prices > 1e-12, prices, -np.inf)
    worth = np.zeros(units + 1)
    took = np.zeros(units + 1, np.int64)  # 0: this unit stays empty
    for room in range(1, units + 1):
        options = prices[1 : room + 1] + worth[:room][::-1]
        kind = int(options.argmax())
        if options[kind] > worth[room - 1]:
            worth[room], took[room] = options[kind], kind + 1
        else:
            worth[room] = worth[room - 1]
    counts = np.zeros(units + 1, np.int64)
    room = units
    while room > 0:
        counts[took[room]] += took[room] > 0
        room -= max(1, took[room])
    return float(worth[units]), counts


def solve_patterns(demand: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Patterns with fractional uses that cover ``demand[c]`` rests of each class ``c``.

    Revised simplex: the basis starts with one pattern per class, and each
    priced pattern replaces the basic one that runs out first.
    """
    units = len(demand) - 1
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    own = units // classes
    basis = [np.bincount([c], [k], units + 1).astype(np.int64) for c, k in zip(classes, own)]
    inverse = np.diag(1.0 / own)
    uses = demand[classes] / own
    for _ in range(rounds):
        prices = np.full(units + 1, -np.inf)
        prices[classes] = inverse.sum(axis=0)
        worth, counts = best_pattern(prices)
        if worth <= 1 + 1e-7:
            break
        column = inverse @ counts[classes]
        limits = np.where(column > 1e-9, uses / np.where(column > 1e-9, column, 1), np.inf)
        leaves = int(limits.argmin())
        step = limits[leaves]
        uses -= step * column
        uses[leaves] = step
        uses = uses.clip(min=0)
        pivot = inverse[leaves] / column[leaves]
        inverse -= np.outer(column, pivot)
        inverse[leaves] = pivot
        basis[leaves] = counts
    return list(zip(basis, uses))


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN) -> list[tuple[int, int, int, int, int, int]]:
    """``class, from, upto, each, slot, sequence``: who goes where.

    Rests ``from <= rank < upto`` of a class take ``each`` places in every
    sequence counted from ``sequence``; ``slot`` orders classes inside it.
    """
    units = capacity // grain
    demand = np.zeros(units + 1)
    for kind, count in histogram.items():
        demand[kind] = count
    left = demand.astype(np.int64)
    plan: list[tuple[np.ndarray, int]] = []
    for counts, uses in solve_patterns(demand):
        times = int(uses + 1e-6)
        shown = counts[counts > 0]
        if times and len(shown):
            times = min(times, int((left[counts > 0] // shown).min()))
        if times > 0:
            plan.append((counts, times))
            left -= counts * times
    while left.any():  # at most about one sequence per pattern remains
        counts, room = np.zeros(units + 1, np.int64), units
        while room and (fits := np.flatnonzero(left[1 : room + 1] - counts[1 : room + 1] > 0)).size:
            kind = int(fits[-1]) + 1
            take = min(int(left[kind] - counts[kind]), room // kind)
            counts[kind] += take
            room -= take * kind
        times = int((left[counts > 0] // counts[counts > 0]).min())
        plan.append((counts, times))
        left -= counts * times
    rows, taken, sequence = [], np.zeros(units + 1, np.int64), 0
    for counts, times in plan:
        for slot, kind in enumerate(np.flatnonzero(counts)[::-1]):
            each = int(counts[kind])
            rows.append((int(kind), int(taken[kind]), int(taken[kind] + each * times), each, slot, sequence))
            taken[kind] += each * times
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, key: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``key, start, length``, others kept).

    Lengths must lie in ``1 .. capacity``. Sequences are numbered from 0 and
    filled without gaps from offset 0; no piece is left out. Ranks come from a
    range sort over class and key, so a length shared by a third of all rows
    spreads over many tasks. An empty table stays empty.
    """
    spark = pieces.sparkSession
    classed = stored(pieces.withColumn("_class", F.ceil(F.col("length") / grain).cast("int")), "pieces")
    histogram = {r["_class"]: r["n"] for r in classed.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    rows = plan_sequences(histogram, capacity, grain)
    plan = spark.createDataFrame(rows, "_kind int, _from long, _upto long, _each long, _slot int, _first long")
    ranked = number_rows(classed, ["_class"], [key, "start"], "_rank", start=0)
    placed = ranked.join(
        F.broadcast(plan),  # bounded: see plan_sequences
        (F.col("_class") == F.col("_kind")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto")),
    ).withColumn("sequence_id", F.col("_first") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each")))
    inside = Window.partitionBy("sequence_id").orderBy("_slot", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(
        *pieces.columns, "sequence_id", "offset"
    )


def padded_length(length: int, capacity: int = CAPACITY) -> int:
    """A sequence is padded to ``capacity`` unless its length is a power of two."""
    return length if length & (length - 1) == 0 else capacity


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the padded sequences of packed pieces with ``ids``.

    A sequence has at most ``capacity`` pieces, so a group is bounded.
    """
    group = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts")
    )
    whole = F.aggregate("_parts", F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part["ids"]))
    full = F.when(F.expr("n_tokens & (n_tokens - 1)") == 0, F.col("n_tokens")).otherwise(capacity)
    filler = F.lit(pad.to_bytes(4, "little")).cast("binary")
    padding = F.aggregate(
        F.array_repeat(filler, (full - F.col("n_tokens")).cast("int")),
        F.lit(b"").cast("binary"),
        lambda done, one: F.concat(done, one),
    )
    return group.select("sequence_id", "n_tokens", F.concat(whole, padding).alias("ids"))
