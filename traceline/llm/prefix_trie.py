"""Prefix tree of conversations, built by halving the depth.

Conversations stay in long form, a row per turn, so one of any length spreads
over many tasks. The depth range is cut in half again and again, as a van Emde
Boas layout cuts a tree: at each level every sequence that reaches the cut of
its segment gets a name for the prefix up to the cut. What lies above the cut
is the upper tree, what lies below hangs under the names as lower trees, and
all upper and lower trees of a level are cut together in the next one. A name
depends on the name of the segment's root and the run of turns up to the cut
alone, so equal prefixes of different conversations get equal names without a
shuffle by prefix. Totals are grafted the other way round, smallest segments
first: the totals of the lower trees under a cut go to the nodes between the
cut and the root of its segment.

With ``N`` rebuilt turns and depth ``D`` there are ``log2 D`` levels. Naming
moves about ``2 N`` narrow rows in all, grafting at most ``N`` in a level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.operators.ranking import number_rows
from traceline.runtime import stored

EVERY = 100  # conversations of a hundred share the turns of its first
MOST = 6  # shared turns are fewer than this
ROOT = b""  # name of the empty prefix


def _digest(column: Column) -> Column:
    return F.unhex(F.sha2(column, 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, token, chars``: turns numbered from 1, NULL turns first.

    ``token`` is the SHA-256 of role and text (NULL: empty), ``chars`` the code
    points of the text. Turns of one number follow each other by token; rows
    without a conversation take no part. Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("token"),
        F.length(text).cast("long").alias("chars"),
    )
    numbered = number_rows(stored(turns, "turns"), ["conv_id"], ["turn", "token"], "place")
    return numbered.select("conv_id", F.col("place").cast("long").alias("place"), "token", "chars")


def rebuild(turns: DataFrame, every: int = EVERY, most: int = MOST) -> DataFrame:
    """``conv_id, depth, token, chars``: each conversation begins with turns of the first of its ``every``.

    ``h`` is the CRC-32 of the decimal id modulo ``most``. Conversation ``c``
    takes the first ``h`` turns of ``c - c % every`` and goes on with its own
    after its first ``h``. ``turns`` is read several times and should be a
    written table.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    own = turns.select("conv_id", base.alias("base"), h.alias("h"), "place", "token", "chars")
    first = own.where((F.col("place") < most) & (F.col("conv_id") == F.col("base"))).select("base", "place", "token", "chars")
    # At most ``every`` conversations share a base, and a base lends fewer than ``most`` turns.
    taken = (
        own.where(F.col("place") == 1)
        .select("conv_id", "base", "h")
        .join(first, "base")
        .where(F.col("place") <= F.col("h"))
        .select("conv_id", F.col("place").alias("depth"), "token", "chars")
    )
    lent = first.groupBy("base").agg(F.count("*").alias("lent"))
    rest = own.where(F.col("place") > F.col("h")).join(lent, "base", "left")
    shift = F.least(F.col("h"), F.coalesce("lent", F.lit(0))) - F.col("h")
    return taken.unionByName(rest.select("conv_id", (F.col("place") + shift).alias("depth"), "token", "chars"))


def _doubled(runs: DataFrame) -> DataFrame:
    """Runs of twice the length; a run that lacks its second half is left out."""
    half = F.shiftright("at", 1).alias("at")
    first = runs.where(F.col("at") % 2 == 0).select("conv_id", half, F.col("token").alias("first"))
    second = runs.where(F.col("at") % 2 == 1).select("conv_id", half, F.col("token").alias("second"), "chars")
    return first.join(second, ["conv_id", "at"]).select(
        "conv_id", "at", _digest(F.concat("first", "second")).alias("token"), "chars"
    )


def name_prefixes(turns: DataFrame) -> tuple[DataFrame, int]:
    """``conv_id, depth, name, parent, chars`` of every prefix of every sequence, and the number of levels.

    ``turns`` is a written table ``conv_id, depth, token, chars`` with depths
    from 1 without gaps. Only the greatest depth reaches the driver.
    """
    deepest = turns.agg(F.max("depth")).first()[0] or 0
    levels = int(deepest).bit_length()
    runs = [turns.select("conv_id", (F.col("depth") - 1).alias("at"), "token", "chars")]
    for _ in range(levels - 1):
        runs.append(stored(_doubled(runs[-1]), "runs"))
    named: list[DataFrame] = []
    for level in reversed(range(levels)):
        # Segments of 2^(level + 1) are cut after their first half.
        cuts = (
            runs[level]
            .where(F.col("at") % 2 == 0)
            .select(
                "conv_id",
                F.shiftleft("at", level).alias("root_depth"),
                F.shiftleft(F.col("at") + 1, level).alias("depth"),
                "token",
                "chars",
            )
        )
        root: Column = F.lit(ROOT)
        if named:
            above = reduce(DataFrame.unionByName, named)
            roots = above.select("conv_id", F.col("depth").alias("root_depth"), F.col("name").alias("root"))
            cuts = cuts.join(roots, ["conv_id", "root_depth"], "left")
            root = F.coalesce("root", F.lit(ROOT))
        named.append(stored(cuts.select("conv_id", "depth", _digest(F.concat(root, "token")).alias("name"), "chars"), "names"))
    empty = turns.select("conv_id", "depth", F.col("token").alias("name"), "chars").limit(0)
    names = reduce(DataFrame.unionByName, named, empty)
    parents = names.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    return (
        names.join(parents, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(ROOT))),
        levels,
    )


def _graft(nodes: DataFrame, names: DataFrame, levels: int) -> DataFrame:
    """``name, saved_tokens, n_leaves``: own values of all nodes and of all nodes below.

    In a level the tops of the lower trees know the totals of their trees. The
    sums under a cut travel along one conversation that passes it, whose named
    prefixes are the cut's ancestors.
    """
    columns = ["name", "parent", "depth", "conv_id", "saved_tokens", "n_leaves"]
    parts = [nodes.select(*columns)]
    for level in range(levels):
        half, place = 1 << level, (F.col("depth") - 1) % (2 << level)
        tops = reduce(DataFrame.unionByName, [p.where(place == half) for p in parts])
        under = tops.groupBy(F.col("parent").alias("cut_name")).agg(
            F.min("conv_id").alias("conv_id"),
            (F.min("depth") - 1).alias("cut"),
            F.sum("saved_tokens").alias("saved_tokens"),
            F.sum("n_leaves").alias("n_leaves"),
        )
        upper = names.where(place < half).select("conv_id", "name", "parent", "depth", (F.col("depth") - place + half - 1).alias("cut"))
        parts.append(
            stored(
                upper.join(under.drop("cut_name"), ["conv_id", "cut"])
                .groupBy("name", "parent", "depth")
                .agg(
                    F.min("conv_id").alias("conv_id"),
                    F.sum("saved_tokens").alias("saved_tokens"),
                    F.sum("n_leaves").alias("n_leaves"),
                )
                .select(*columns),
                "grafted",
            )
        )
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("name").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``name, conv_id`` rows to one row per name and batch with the ids as text."""
    for batch in batches:
        names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        starts = [i for i in range(len(ids)) if not i or names[i] != names[i - 1]]
        ends = [*starts[1:], len(ids)]
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[a] for a in starts], pa.binary()),
                pa.array([ids[a] for a in starts], pa.int64()),
                pa.array(texts, pa.string()),
            ],
            names=["name", "first", "ids"],
        )


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs to one hash per name; only the state of one hash is held."""
    name, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if state is not None and key == name:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((name, state.hexdigest()))
            name, state = key, hashlib.sha256(ids.encode())
        yield _hashes(done)
    if state is not None:
        yield _hashes([(name, state.hexdigest())])


def _hashes(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())], names=["name", "ends_sha256"]
    )


def end_hashes(ends: DataFrame) -> DataFrame:
    """``name, ends_sha256`` over the ascending, comma-joined ids of each name, from a written table ``name, conv_id``.

    A hash takes its bytes one after the other, so the ids of a name end in one
    task. They are sorted and joined by ranges over name *and* id before, and
    the hashing task streams those long texts; it holds none of them.
    """
    runs = (
        ends.select("name", "conv_id")
        .repartitionByRange("name", "conv_id")
        .sortWithinPartitions("name", "conv_id")
        .mapInArrow(_joined_runs, "name binary, first long, ids string")
    )
    return (
        runs.repartition("name")
        .sortWithinPartitions("name", "first")
        .select("name", "ids")
        .mapInArrow(_hashed_runs, "name binary, ends_sha256 string")
    )


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences in ``turns``, the root among them.

    ``turns`` is a written table ``conv_id, depth, token, chars``;
    ``conversations`` holds each ``conv_id`` once, those without turns too,
    which end at the root. Gives ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. Without conversations there is no
    root and no row.
    """
    prefixes, levels = name_prefixes(turns)
    names = stored(prefixes, "prefixes")
    counted = names.groupBy("name", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")
    )
    counted = stored(counted, "nodes")
    children = counted.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = stored(
        counted.join(children, "name", "left").select(
            "name",
            "parent",
            "depth",
            "conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ),
        "own",
    )
    totals = nodes.drop("saved_tokens", "n_leaves").join(_graft(nodes, names, levels), "name")
    totals = stored(totals, "totals")

    lengths = names.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    turnless = conversations.join(lengths, "conv_id", "left_anti").select(F.lit(ROOT).alias("name"), "conv_id")
    ends = stored(names.join(lengths, ["conv_id", "depth"]).select("name", "conv_id").unionByName(turnless), "ends")

    # The root has no name to be joined by; four numbers describe it.
    least, members = conversations.agg(F.min("conv_id"), F.count("*")).first()
    tops = totals.where(F.col("depth") == 1).agg(F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    n_children, n_leaves, saved = tops[0], tops[1] or 1, tops[2] or 0
    root = conversations.sparkSession.range(1 if members else 0).select(
        F.lit(ROOT).alias("name"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(least).cast("long").alias("conv_id"),
        F.lit(members).cast("long").alias("n_convs"),
        F.lit(n_children).cast("long").alias("n_children"),
        F.lit(saved).cast("long").alias("saved_tokens"),
        F.lit(n_leaves).cast("long").alias("n_leaves"),
    )
    # Nodes of depth 1 know their parent without the join, which spares it the root as a hot key.
    above = totals.select(F.col("name").alias("parent"), F.col("conv_id").alias("_above"))
    linked = (
        totals.withColumn("parent", F.when(F.col("depth") > 1, F.col("parent")))
        .join(above, "parent", "left")
        .withColumn("parent_conv_id", F.coalesce("_above", F.lit(least).cast("long")))
        .drop("_above")
    )
    every = linked.unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("long")))
    return every.join(end_hashes(ends), "name", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, every: int = EVERY, most: int = MOST) -> DataFrame:
    """The prefix tree of the rebuilt conversations (``conv_id, turn, role, text``; other columns are not read)."""
    turns = stored(ordered_turns(conversations), "ordered")
    ids = stored(turns.where(F.col("place") == 1).select("conv_id"), "conversations")
    return prefix_trie(stored(rebuild(turns, every, most), "rebuilt"), ids)
