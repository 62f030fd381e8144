"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Two models, one of labelled toxic and one of labelled ordinary texts, give the
probability of each letter after up to ``ORDER - 1`` letters of its word. Each
model discounts its own counts; what it sets aside goes to shorter contexts and
in the end to continuation counts that both share, so an expression that is
rare in either gets nearly the same probability from both. A word is worth the
difference of its two log-likelihoods; a text is judged by differences per word
(over the whole text, its toxic side alone, its strongest passage and its
strongest words), which a logistic curve turns into a score. The curve is
fitted on labelled texts that the counts behind it have not seen.

Counts cover all labelled rows. N-grams are hashed to ``2**BITS`` slots per
order, which bounds the model that is broadcast, whatever the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceline.llm.texts import Memo, slices, strings

ORDER = 5
SHARED = 2  # orders up to this one use counts of both classes together
BITS = 18
DISCOUNT = 0.75
PASSAGE = 12  # words
STRONGEST = 3  # words
MOST = (4.0, 15.0)  # a passage or the strongest words count up to this difference per word
FEATURES = ["whole", "toxic_side", "passage", "strongest"]
CALIBRATION = 20_000  # labelled texts at most that the logistic curve is fitted on

_LETTERS = re.compile(r"[^\W\d_]+")
_COUNTS = ["toxic", "ordinary", "late_toxic", "late_ordinary"]
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The letters of each blank-separated piece of a text; a piece without letters is an empty word.

    Counting and scoring both cut texts by this.
    """
    return [word_of(piece) for piece in text.lower().split()]


def word_of(piece: str) -> str:
    return "".join(_LETTERS.findall(piece))


def _slots(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots of the n-grams that end at each letter, per order, and the words' bounds.

    Every word is framed by an opening and a closing mark. Order 0 is the empty
    context. Entries whose n-gram would reach before the opening mark are -1.
    """
    text = "".join(f"\x02{word}\x03" for word in words)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.array([len(word) + 2 for word in words])
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    slots = [np.zeros(len(codes), np.int64)]
    mixed = np.zeros(len(codes), np.uint64)
    for order in range(1, ORDER + 1):
        shifted = np.zeros_like(codes)
        shifted[order - 1 :] = codes[: len(codes) - order + 1]
        mixed = (mixed ^ (shifted + np.uint64(order))) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        slot = ((mixed * _MULTIPLIER) >> np.uint64(64 - BITS)).astype(np.int64)
        slots.append(np.where(place >= order - 1, slot, -1))
    return slots, starts, place


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """``ord, slot, context, suffix`` and counts by class of ``text, toxic, late`` rows.

    ``context`` is the slot of the n-gram without its last letter, ``suffix``
    without its first; rows that are ``late`` are counted apart. Words are added
    up inside a task, then n-grams.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for part in slices(batches):
            for text, toxic, late in zip(strings(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist()):
                column = (0 if toxic else 1) + 2 * late
                for word, n in Counter(words_of(text)).items():
                    if word:
                        found.setdefault(word, [0, 0, 0, 0])[column] += n
            if len(found) > 300_000:
                yield from _counted(found)
                found = {}
        yield from _counted(found)

    schema = "ord int, slot long, context long, suffix long" + "".join(f", {name} long" for name in _COUNTS)
    rows = labelled.select("text", "toxic", "late").mapInArrow(task, schema)
    return rows.groupBy("ord", "slot").agg(
        *[F.min(name).alias(name) for name in ("context", "suffix")], *[F.sum(name).alias(name) for name in _COUNTS]
    )


def _counted(found: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
    if not found:
        return
    slots, _, place = _slots(list(found))
    lengths = np.diff(np.append(np.flatnonzero(place == 0), len(place)))
    counts = np.repeat(np.array(list(found.values()), np.int64), lengths, axis=0)
    for order in range(1, ORDER + 1):
        # The opening mark is given, so it is counted as a context only.
        use = np.flatnonzero((slots[order] >= 0) & (place > 0))
        slot, at = np.unique(slots[order][use], return_inverse=True)
        one = np.zeros(len(slot), np.int64)
        one[at] = use
        context = slots[order - 1][one - 1] if order > 1 else np.zeros(len(one), np.int64)
        sums = [np.bincount(at, counts[use, c], len(slot)).astype(np.int64) for c in range(len(_COUNTS))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(slot), order, np.int32)), *map(pa.array, (slot, context, slots[order - 1][one], *sums))],
            names=["ord", "slot", "context", "suffix", *_COUNTS],
        )


@dataclass
class Model:
    """Per order and class: the discounted share of an n-gram and what its context passes on."""

    shares: list[np.ndarray]  # [order][class, slot]
    passed: list[np.ndarray]  # [order][class, context slot]
    curve: np.ndarray  # bias and weights of the logistic curve

    def words(self, words: list[str]) -> list[float]:
        """Toxic minus ordinary log-likelihood of each word."""
        if not words:
            return []
        slots, starts, place = _slots(words)
        probability = np.full((2, len(place)), 1e-6)
        for order in range(1, ORDER + 1):
            here = slots[order]
            before = np.zeros(len(here), np.int64) if order == 1 else np.append(-1, slots[order - 1][:-1])
            ok = (here >= 0) & (before >= 0) & (place > 0)
            share = np.where(ok, self.shares[order][:, here], 0)
            passed = np.where(ok, self.passed[order][:, before], 1)
            probability = share + passed * probability
        gain = np.log(probability[0] / probability[1])
        gain[place == 0] = 0
        return np.add.reduceat(gain, starts).tolist()


def estimate(counts: pa.Table, early: bool = False) -> Model:
    """Kneser-Ney shares from the counted n-grams (at most ``ORDER * 2**BITS`` rows).

    ``early`` leaves the late rows out.
    """
    size = 1 << BITS
    rows = {name: counts.column(name).to_numpy() for name in counts.column_names}
    if early:
        met = rows["toxic"] + rows["ordinary"] > 0
        rows = {name: values[met] for name, values in rows.items()}
    else:
        rows["toxic"], rows["ordinary"] = rows["toxic"] + rows["late_toxic"], rows["ordinary"] + rows["late_ordinary"]
    shares = [np.zeros((2, size))] + [np.zeros((2, size)) for _ in range(ORDER)]
    passed = [np.ones((2, size))] + [np.ones((2, size)) for _ in range(ORDER)]
    for order in range(1, ORDER + 1):
        mine = rows["ord"] == order
        slot, context = rows["slot"][mine], rows["context"][mine]
        if order <= SHARED:
            longer = rows["ord"] == order + 1
            seen = np.bincount(rows["suffix"][longer], minlength=size).astype(float)
            seen = np.maximum(seen[slot], 1)  # how many letters go before it, in either class
            pair = [seen, seen]
        else:
            pair = [rows["toxic"][mine].astype(float), rows["ordinary"][mine].astype(float)]
        for c, n in enumerate(pair):
            total = np.bincount(context, n, size)
            kinds = np.bincount(context, n > 0, size)
            used = total > 0
            passed[order][c, used] = DISCOUNT * kinds[used] / total[used]
            good = total[context] > 0
            shares[order][c, slot[good]] = np.maximum(n[good] - DISCOUNT, 0) / total[context[good]]
    return Model([s.astype(np.float32) for s in shares], [p.astype(np.float32) for p in passed], np.zeros(1 + len(FEATURES)))


def features(gains: list[float]) -> tuple[float, float, float, float]:
    """Log-likelihood differences per word, in the order of ``FEATURES``."""
    if not gains:
        return 0.0, 0.0, 0.0, 0.0
    values = np.array(gains)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    passage = (sums[PASSAGE:] - sums[:-PASSAGE]).max() if len(values) > PASSAGE else sums[-1]
    strongest = np.partition(values, -STRONGEST)[-STRONGEST:] if len(values) > STRONGEST else values
    return (
        float(values.mean()),
        float(values.clip(min=0).mean()),
        min(float(passage / PASSAGE), MOST[0]),
        min(float(strongest.sum() / STRONGEST), MOST[1]),
    )


def _features(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``FEATURES``; one narrow pass."""
    # Arrays only: a broadcast is unpickled without the code that travels with a task.
    shared, curve = docs.sparkSession.sparkContext.broadcast((model.shares, model.passed)), model.curve

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda pieces: Model(*shared.value, curve).words([word_of(p) for p in pieces]))
        for part in slices(batches):
            words = [text.lower().split() for text in strings(part.column(0))]
            found = np.array([features(gains) for gains in memo.of(words)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], *map(pa.array, found.T.copy())], names=[*keep, *[f"_{name}" for name in FEATURES]]
            )

    fields = [docs.schema[k] for k in keep] + [T.StructField(f"_{name}", T.DoubleType()) for name in FEATURES]
    return docs.select("text", *keep).mapInArrow(task, T.StructType(fields))


def fit_curve(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, lightly ridged; bias first."""
    if len(set(toxic)) < 2:
        return np.array([-5.0] + [1.0] * len(FEATURES))
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), 0.01 * np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + ridge @ w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, gradient)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def remainder(key: str = "doc_id"):
    """crc32 of the key's text modulo 5: the fold of a document."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", calibration: int = CALIBRATION) -> Model:
    """A model from ``docs`` whose label ``toxic`` is known and whose fold is not 0.

    All of folds 1 to 4 are counted. The curve is fitted on at most
    ``calibration`` texts of fold 1, in an order fixed by a hash, judged by the
    counts of the other folds. Rows with a NULL key or label teach nothing; a
    repeated label counts once per row.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & (remainder(key) != 0))
    known = known.select(key, F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(key, "text").where(remainder(key) != 0)
    taught = texts.join(known.hint("shuffle_hash"), key).select("text", "toxic", (remainder(key) == 1).alias("late"))
    counts = count_ngrams(taught).toArrow()
    early = estimate(counts, early=True)
    sample = F.broadcast(known.where(remainder(key) == 1).orderBy(F.xxhash64(key), key, "toxic").limit(calibration))
    held = _features(texts.where(remainder(key) == 1).join(sample, key), early, ["toxic"]).toArrow()
    columns = [held.column(f"_{name}").to_numpy() for name in FEATURES]
    model = estimate(counts)
    model.curve = fit_curve(np.column_stack(columns), held.column("toxic").to_numpy().astype(float))
    return model


def _evidence(model: Model) -> Column:
    """Log-odds of toxic from the feature columns."""
    value = F.lit(float(model.curve[0]))
    for name, weight in zip(FEATURES, model.curve[1:]):
        value = value + F.col(f"_{name}") * float(weight)
    return value


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` of every row.

    A text without words (NULL or empty too) has no evidence and gets the
    score of the curve at zero. Keys may be NULL (not held out) or repeat.
    """
    return (
        _features(docs, model, [key])
        .withColumn("score", 1 / (1 + F.exp(-_evidence(model))))
        .select(
            key,
            F.coalesce(remainder(key) == 0, F.lit(False)).alias("held_out"),
            "score",
            (F.col("score") >= 0.5).cast("int").alias("predicted"),
        )
    )


def keep_ordinary(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, columns unchanged whatever their names."""
    model = train(docs, labels, key)
    rows = docs.select("text", F.struct(*docs.columns).alias("_row"))
    return _features(rows, model, ["_row"]).where(_evidence(model) < 0).select("_row.*")
