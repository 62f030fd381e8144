"""SimHash fingerprints and radius search, in column expressions only.

A term is a pair of neighbouring words (a lone word stands for itself), its
weight grows with its length. Each bit of a term's 64-bit hash votes with the
term's weight, and a fingerprint bit is set when more than half of the weight
votes for it. Votes of bits ``i`` and ``i + 32`` share one sum of longs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.operators.ranking import number_rows
from traceline.runtime import stored

_BLANKS = "[\\x20\\x09-\\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"
_PAIR = (1 << 32) | 1
_LOW = (1 << 32) - 1
_HEAVIEST = 4


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANKS))


def _terms(words: str, which: int) -> Column:
    """``which, h, w`` of every term of a word column."""

    def term(i: Column) -> Column:
        one, two = F.get(words, i), F.get(words, i + 1)
        size = F.length(one) + F.coalesce(F.length(two), F.lit(0))
        weight = F.least(F.floor(size / 5) + 1, F.lit(_HEAVIEST)).cast("long")
        return F.struct(F.lit(which).alias("which"), F.xxhash64(one, two).alias("h"), weight.alias("w"))

    many = F.size(words)
    none = F.array().cast("array<struct<which:int,h:bigint,w:bigint>>")
    return F.when(many == 0, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(many - 2, F.lit(0))), term))


def _voted(total: Column) -> Column:
    """The fingerprint from the sums ``_v0 .. _v31`` and the total weight."""
    bits = []
    for i in range(32):
        low, high = F.col(f"_v{i}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(f"_v{i}", 32)
        bits.append(F.when(2 * low > total, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        top = (1 << (i + 32)) - ((1 << 64) if i == 31 else 0)
        bits.append(F.when(2 * high > total, F.lit(top)).otherwise(F.lit(0)).cast("long"))
    return reduce(Column.bitwiseOR, bits)


def fingerprint(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys``, ``n_rows`` and a fingerprint ``fp_<column>`` (long) of each text column.

    Rows with equal keys must have equal texts; they give one row and are
    counted in ``n_rows``. A text without words (NULL too) has the fingerprint
    0. Terms are added up in the task that reads the text, before the shuffle.
    """
    worded = texts.select(*keys, *[_words(F.coalesce(F.col(c), F.lit(""))).alias(f"_w{i}") for i, c in enumerate(columns)])
    marks = F.array(
        *[
            F.struct(F.lit(i).alias("which"), F.lit(None).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("w"))
            for i in range(len(columns))
        ]
    )
    terms = worded.select(*keys, F.inline(F.concat(marks, *[_terms(f"_w{i}", i) for i in range(len(columns))])))
    lanes = [
        F.coalesce(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_PAIR)) * F.col("w")), F.lit(0)).alias(f"_v{i}")
        for i in range(32)
    ]
    voted = (
        terms.groupBy(*keys, "which")
        .agg(F.sum("w").alias("_weight"), F.count(F.when(F.col("h").isNull(), 1)).alias("n_rows"), *lanes)
        .select(*keys, "which", "n_rows", _voted(F.col("_weight")).alias("_fp"))
    )
    one = [F.max(F.when(F.col("which") == i, F.col("_fp"))).alias(f"fp_{c}") for i, c in enumerate(columns)]
    return voted.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), *one)


def likeness(one: str, two: str) -> Column:
    """Share of equal bits of two fingerprint columns."""
    return 1 - F.bit_count(F.col(one).bitwiseXOR(F.col(two))) / 64


def within_radius(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """``a, b, distance``: all pairs of distinct fingerprints ``fp`` within the radius, ``a < b``.

    The bits are cut into ``blocks`` (default ``radius + 2``) and tables are
    made for every choice of ``blocks - radius`` of them, which lead the
    permuted fingerprint: a close pair agrees on the lead of some table. Equal
    fingerprints are one; a NULL is none. Every pair is returned, so a group of
    near fingerprints gives a row for each of its pairs.
    """
    blocks = blocks or radius + 2
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (bounds[b + 1] - bounds[b])) - 1) << bounds[b] for b in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("lead")) for i, m in enumerate(masks)])
    rows = prints.where(F.col("fp").isNotNull()).select("fp").distinct().select("fp", F.inline(tables))
    one, two = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return (
        one.join(two, ["table", "lead"])
        .where((F.col("a") < F.col("b")) & (distance <= radius))
        .select("a", "b", distance.alias("distance"))
        .distinct()
    )


def with_next_edit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, _th, text, edited, n_chars, next_key``: each text and its edited form.

    The last quarter of the code points (rounded down) is replaced by the first
    as many of the next document in the order of keys, NULL first; the first
    follows the last. Rows that share a key have the same next document: of
    rows that share the next key, the one with the least text hash. The order
    is found on keys alone; of the texts only beginnings move to a neighbour.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    quarter = F.floor(F.length("_text") / 4).cast("int")
    ranked = number_rows(rows.groupBy("_key").agg(F.max(quarter).alias("_want")), [], ["_key"], "_rank", start=0)
    many = ranked.count()
    after = ranked.select(F.col("_key").alias("_after"), F.pmod(F.col("_rank") - 1, F.lit(max(1, many))).alias("_rank"))
    follows = stored(ranked.join(after, "_rank").select("_key", "_want", "_after"), "follows")
    asked = follows.select(F.col("_key").alias("_for"), "_want", "_after")
    heads = (
        rows.join(asked, F.col("_key").eqNullSafe(F.col("_after")))
        .select("_for", "_after", F.struct(F.xxhash64("_text").alias("th"), F.expr("substring(_text, 1, _want)").alias("head")).alias("_one"))
        .groupBy("_for", "_after")
        .agg(F.min("_one")["head"].alias("_head"))
    )
    joined = rows.join(heads, F.col("_key").eqNullSafe(F.col("_for")))
    cut = joined.withColumn("n_chars", F.length("_text").cast("long")).withColumn("_q", quarter)
    edited = F.concat(F.expr("substring(_text, 1, int(n_chars - _q))"), F.expr("substring(_head, 1, _q)"))
    return cut.select(
        F.col("_key").alias(key), F.xxhash64("_text").alias("_th"), F.col("_text").alias("text"), edited.alias("edited"), "n_chars",
        F.col("_after").alias("next_key"),
    )


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next`` of every row."""
    edits = with_next_edit(docs, key, text).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = [key, "_th", "n_chars", "edited_sha256", "next_key"]
    made = stored(fingerprint(edits, keys, ["text", "edited"]), "prints")
    first = made.groupBy(F.col(key).alias("_next")).agg(F.min(F.struct("_th", F.col("fp_text").alias("fp")))["fp"].alias("_fp_next"))
    found = made.join(first, F.col("next_key").eqNullSafe(F.col("_next")))
    return found.select(
        key,
        "n_chars",
        "edited_sha256",
        F.col("fp_text").alias("fp"),
        F.col("fp_edited").alias("edited_fp"),
        likeness("fp_text", "fp_edited").alias("near_edited"),
        likeness("fp_text", "_fp_next").alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("_copy"),
    ).drop("_copy")
