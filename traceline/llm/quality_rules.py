"""Quality rules learned as a decision list of threshold conjunctions.

Statistics of a text are column expressions. From labelled rows sequential
covering grows one conjunction of thresholds at a time towards the rejected
class, prunes it on rows it was not grown on, removes what it covers and goes
on while a rule is precise enough. The list becomes one ordered conditional
expression, so applying it is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"  # the blanks between words
_BLANKS = "[\\x20\\x09-\\x0D]+"
WINDOW = 5  # words of a repeated window
SYMBOLS = "[#*$%&|<>]"

SAMPLE = 20_000  # labelled rows at most that rules are learned from
CUTS = 24  # thresholds tried per statistic
LITERALS = 3  # conditions in a rule at most
PRECISION = 0.95  # of a rule, on the rows it is pruned on
SUPPORT = 4  # rejected rows a rule has to cover there

FEATURES = ["n_words", "word_length", "symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "variety"]


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the shares behind ``FEATURES``.

    A NULL text has no words; shares of nothing are 0. Windows are compared by
    64-bit hashes inside one text. The text itself is not changed. Columns of
    ``docs`` that have these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(BLANK))
    first = docs.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANKS)))
    first = first.withColumn("_lines", F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != ""))

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get("_words", i + j) for j in range(WINDOW)])

    many = F.size("_words")
    hashes = F.when(many >= WINDOW, F.transform(F.sequence(F.lit(0), many - WINDOW), window)).otherwise(
        F.array().cast("array<bigint>")
    )
    second = first.select(
        *[c for c in docs.columns],
        many.cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        F.size(F.array_distinct("_words")).cast("long").alias("_kinds"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.regexp_count(whole, F.lit("[A-Z]")).cast("long").alias("_upper"),
        (F.length(whole) - F.length(F.replace(F.replace(whole, F.lit("!"), F.lit("")), F.lit("?"), F.lit("")))).cast("long").alias("_marks"),
        hashes.alias("_hashes"),
    )
    # Windows found twice stand next to each other in hash order; the words under them are counted once.
    third = second.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    again = F.filter(
        "_sorted",
        lambda e, j: (e["h"] == F.get("_sorted", j - 1)["h"]) | F.coalesce(e["h"] == F.get("_sorted", j + 1)["h"], F.lit(False)),
    )
    fourth = third.withColumn("_places", F.array_sort(F.transform(again, lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("_places", lambda p, j: F.coalesce(F.least(F.get("_places", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    counts = {
        "n_words": F.col("_n_words"),
        "word_chars": F.col("_word_chars"),
        "n_symbols": F.col("_n_symbols"),
        "n_dup_lines": F.col("_n_dup_lines"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    }
    kept = [c for c in docs.columns if c not in counts and c not in FEATURES]
    fifth = fourth.select(*kept, *[c.alias(name) for name, c in counts.items()], "_kinds", "_n_lines", "_upper", "_marks")

    def share(part: str, of: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(of).cast("double")), F.lit(0.0))

    return fifth.select(
        *kept,
        *counts,
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"),
        share("_upper", "word_chars").alias("upper_share"),
        share("_marks", "n_words").alias("mark_share"),
        share("_kinds", "n_words").alias("variety"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    """``feature >= cut`` or ``feature < cut``."""

    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.cut if self.above else value < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:g}"


Rule = tuple[Literal, ...]


def _holds(rows: list[Row]) -> dict[Literal, int]:
    """The rows (as bits) in which each literal holds."""
    held: dict[Literal, int] = {}
    for feature in FEATURES:
        values = [float(row[feature]) for row in rows]
        ranked = sorted(set(values))
        cuts = sorted({ranked[len(ranked) * i // (CUTS + 1)] for i in range(1, CUTS + 1)}) if len(ranked) > 1 else []
        # The ends matter most for rare faults, so the extreme ranks are cut finely as well.
        ordered = sorted(values)
        for i in (0.001, 0.003, 0.01, 0.02, 0.05, 0.95, 0.98, 0.99, 0.997, 0.999):
            cuts.append(ordered[int(i * (len(ordered) - 1))])
        for cut in sorted(set(cuts)):
            above = 0
            for at, value in enumerate(values):
                if value >= cut:
                    above |= 1 << at
            everything = (1 << len(rows)) - 1
            held[Literal(feature, True, cut)] = above
            held[Literal(feature, False, cut)] = everything & ~above
    return held


def _precision(cover: int, bad: int) -> float:
    return (cover & bad).bit_count() / cover.bit_count() if cover else 0.0


def learn_rules(rows: list[Row], label: str = "quality") -> list[Rule]:
    """Ordered rules that reject, from rows with ``FEATURES`` and a label that is 0 for bad texts.

    Two rows of three grow rules, the third prunes them; the rows come in an
    order fixed by the caller. Fewer than 30 rows teach nothing.
    """
    if len(rows) < 30:
        return []
    held = _holds(rows)
    everything = (1 << len(rows)) - 1
    bad = sum(1 << at for at, row in enumerate(rows) if row[label] == 0)
    prune_on = sum(1 << at for at in range(0, len(rows), 3))
    left, rules = everything, []
    while True:
        rule: list[Literal] = []
        cover = left & ~prune_on
        for _ in range(LITERALS):
            now = _precision(cover, bad)
            if not cover & bad or now == 1.0:
                break

            def gain(literal: Literal) -> float:
                after = cover & held[literal]
                hits = (after & bad).bit_count()
                return hits * (_precision(after, bad) - now) if hits else 0.0

            best = max(held, key=gain)
            if gain(best) <= 0:
                break
            rule.append(best)
            cover &= held[best]
        # The shortest beginning of the rule that is precise on the other rows, else the whole rule.
        chosen = None
        for size in range(1, len(rule) + 1):
            cover = left
            for literal in rule[:size]:
                cover &= held[literal]
            seen = cover & prune_on
            if (seen & bad).bit_count() >= SUPPORT and min(_precision(seen, bad), _precision(cover, bad)) >= PRECISION:
                chosen = tuple(rule[:size]), cover
                break
        if chosen is None:
            return rules
        rules.append(chosen[0])
        left &= ~chosen[1]


def rule_expression(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, 0 if none does."""
    out = F.when(F.lit(False), 0)
    for number, rule in enumerate(rules, 1):
        condition = rule[0].column()
        for literal in rule[1:]:
            condition = condition & literal.column()
        out = out.when(condition, number)
    return out.otherwise(0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most ``sample`` labelled rows, drawn in an order fixed by a hash.

    Rows that the base rules reject anyway are left out. Rows with a NULL key
    or label teach nothing.
    """
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).select(key, "quality")
    drawn = known.orderBy(F.xxhash64(key), key, "quality").limit(sample)
    texts = docs.select(key, "text").join(F.broadcast(drawn), key)  # at most ``sample`` short rows
    rows = text_statistics(texts).withColumn("_base", base_failed()).select(key, "quality", "_base", *FEATURES).collect()
    rows = [row for row in rows if not row["_base"]]  # a filter would be pushed below the statistics and repeat them
    return learn_rules(sorted(rows, key=lambda row: (hash_order(row[key]), tuple(row))))


def hash_order(key: object) -> int:
    """An order of keys that has nothing to do with their size."""
    return int.from_bytes(repr(key).encode()[-8:], "little") * 0x9E3779B97F4A7C15 % 2**64


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with its statistics, ``base_failed``, ``rule`` (0: none) and ``kept``."""
    judged = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rule_expression(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged.

    The statistics are made from a copy of the text, so columns of ``docs``
    may have any names. The row number is there for the optimizer: a filter on
    it stays above the statistics instead of repeating them below.
    """
    rules = train(docs, labels, key)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    judged = judge(packed, rules).select("_row", "kept", F.monotonically_increasing_id().alias("_seat"))
    return judged.where(F.col("kept") & (F.col("_seat") >= 0)).select("_row.*")
