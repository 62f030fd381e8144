"""The match as a stored view: results that follow the files without being made again.

Beside the vectors (``operators.vector_store``) a store holds the best files of
every section and repository, some more than are asked for. A removed file
leaves the lists it was in; a new one is scored against the sections and enters
the lists it is good enough for. A list is worked out again only when removals
have used up its reserve.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceline.functions.scoring import angular_distance
from traceline.operators import vector_store
from traceline.operators.embed import Model
from traceline.operators.hits import MIN_DISTANCE
from traceline.operators.knn import nearest
from traceline.operators.requirements import clean_requirements, first_rows, section_vectors
from traceline.plans.match import DEPTH, complete_results, single_results
from traceline.runtime import stored
from traceline.sources.versions import Snapshot, latest, publish, write_part

LIST = ["repo_id", "section_name"]
BEST = "repo_id string, section_name string, first_row long, idx long, path string, cos_sim double, version long"
SECTIONS = "section_name string, first_row long, digest string, embedding array<float>"
MAX_FOLDERS = 8  # folders of lists before they are written together


@dataclass(frozen=True)
class Refresh:
    """A version and what it took to get there, as numbers of texts, sections and lists."""

    snapshot: Snapshot
    embedded: int = 0
    moved: int = 0
    removed: int = 0
    sections: int = 0
    recomputed: int = 0


def section_digests(cleaned: DataFrame) -> DataFrame:
    """``section_name, first_row, digest``: two sums over the hashes of a section's rows, which combine before the shuffle."""
    one, two = F.xxhash64("row_idx", "req_description"), F.xxhash64("req_description", "row_idx", F.lit(1))
    return cleaned.groupBy("section_name").agg(
        F.min("row_idx").cast("long").alias("first_row"),
        F.concat_ws(":", F.count("*"), F.sum(one.cast("decimal(38,0)")), F.sum(two.cast("decimal(38,0)"))).alias("digest"),
    )


def _refreshed_sections(spark: SparkSession, base: Snapshot | None, cleaned: DataFrame, model: Model) -> tuple[DataFrame, DataFrame, int]:
    """All sections with vectors, the names of new and changed ones, and how many changed in any way.

    A section without words has a NULL vector.
    """
    wanted = stored(section_digests(cleaned), "section-digests")
    held = base.read(spark, "sections", SECTIONS) if base else spark.createDataFrame([], SECTIONS)
    on = ["section_name", "first_row", "digest"]
    fresh = stored(wanted.join(held, on, "left_anti").select("section_name"), "fresh-sections")
    removed = held.join(wanted, on, "left_anti").count()
    n_fresh = fresh.count()
    kept = held.join(wanted.select(*on), on, "left_semi")
    if not n_fresh:
        return kept, fresh, removed
    texts = cleaned.join(fresh, "section_name", "left_semi")
    vectors = section_vectors(texts, model).select("section_name", F.col("embedding").cast("array<float>").alias("embedding"))
    made = wanted.join(fresh, "section_name", "left_semi").join(vectors, "section_name", "left").select(*on, "embedding")
    return stored(kept.unionByName(made), "sections"), fresh, n_fresh + removed


def live_best(spark: SparkSession, snapshot: Snapshot | None) -> DataFrame:
    """The lists of a version; an emptied list is a row whose ``idx`` is NULL."""
    if snapshot is None:
        return spark.createDataFrame([], BEST)
    rows = snapshot.read(spark, "best", BEST)
    if len(snapshot.tables.get("best", ())) < 2:
        return rows
    newest = rows.groupBy(*LIST).agg(F.max("version").alias("version"))
    return rows.join(newest, [*LIST, "version"], "left_semi")


def _place() -> Column:
    """Sorts hits from the nearest on; equal cosines by ``idx``."""
    return F.struct((-F.col("cos_sim")).alias("far"), F.col("idx").alias("idx"))


def maintain(
    old: DataFrame, gone: DataFrame, moved: DataFrame, fresh: DataFrame, sizes: DataFrame, depth: int, reserve: int
) -> DataFrame:
    """Lists after files have gone, moved and come: ``LIST, first_row, idx, path, cos_sim, valid, again``.

    ``old`` are the lists, ``gone`` the (``repo_id, path``) that leave them,
    ``moved`` those with another ``pos``, ``fresh`` hits of the new files,
    ``sizes`` how many files (``n``) a repository had. What is left of a list is
    the best of the old files down to its last entry, so a new file may enter
    above that one. Where files have moved, ties with the last entry are open,
    and only what is nearer counts. A list that held all files of its repository
    has no such limit. ``again`` marks lists that are too short and have to be
    searched for.
    """
    shaken = moved.select("repo_id").distinct().withColumn("_shaken", F.lit(True))
    marked = (
        old.where(F.col("idx").isNotNull())
        .join(gone.withColumn("_gone", F.lit(True)), ["repo_id", "path"], "left")
        .join(moved.select("repo_id", "path", F.col("pos").alias("_pos")), ["repo_id", "path"], "left")
        .withColumn("idx", F.coalesce("_pos", "idx"))
        .withColumn("side", F.when(F.col("_gone"), 0).otherwise(1))
    )
    entry = [*LIST, "first_row", "idx", "path", "cos_sim", "side"]
    both = marked.select(*entry).unionByName(fresh.withColumn("side", F.lit(2)).select(*entry))
    both = both.join(sizes, "repo_id", "left").join(shaken, "repo_id", "left")
    # A list has at most ``reserve`` entries of either side.
    each, listed = Window.partitionBy(*LIST), F.col("side") < 2
    above = F.when(F.col("_shaken"), F.col("cos_sim") > F.col("_least")).otherwise((F.col("side") == 1) | (_place() <= F.col("_last")))
    judged = (
        both.withColumn("_full", F.count_if(listed).over(each) >= F.coalesce("n", F.lit(0)))
        .withColumn("_last", F.max(F.when(F.col("side") == 1, _place())).over(each))
        .withColumn("_least", F.min(F.when(listed, F.col("cos_sim"))).over(each))
        .withColumn("valid", (F.col("side") > 0) & (F.col("_full") | F.coalesce(above, F.lit(False))))
        .withColumn("again", ~F.col("_full") & (F.count_if("valid").over(each) < depth))
        .withColumn("_rk", F.row_number().over(each.orderBy(F.col("valid").desc(), _place())))
    )
    return judged.withColumn("valid", F.col("valid") & (F.col("_rk") <= reserve)).select(*LIST, "first_row", "idx", "path", "cos_sim", "valid", "again")


def refresh(
    spark: SparkSession,
    path: str,
    files: DataFrame,
    requirements: DataFrame,
    model: Model,
    depth: int = DEPTH,
    reserve: int | None = None,
) -> Refresh:
    """Bring the store in ``path`` up to date with ``files`` and ``requirements`` and publish that as a version.

    ``files`` (``repo_id, pos, path, content``, a path once in a repository)
    and ``requirements`` are read several times. Without a change nothing is
    embedded, scored, written or published. A store belongs to one model and
    depth; another one raises.
    """
    base = latest(spark, path)
    reserve = max(depth, reserve or 2 * depth + 8)
    note = json.dumps({"model": model.name, "dim": model.dim, "depth": depth})
    if base is not None and base.note != note:
        raise ValueError(f"the store was made for {base.note}, not for {note}")
    before = vector_store.live_vectors(spark, base)
    changes = vector_store.find_changes(files, before)
    sections, fresh_sections, n_sections = _refreshed_sections(spark, base, clean_requirements(requirements), model)
    if base is not None and not changes.any and not n_sections:
        return Refresh(base)

    tables, added = vector_store.write_changes(spark, path, base, files, changes, model)
    version = 1 if base is None else base.version + 1
    after = vector_store.live_vectors(spark, Snapshot(path.rstrip("/"), version, tables))
    asked = ["section_name", "first_row"]

    def hits(vectors: DataFrame, of: DataFrame) -> DataFrame:
        found = nearest(vector_store.as_index(vectors, model), of, reserve, model.dim, by=asked)
        return found.select(*LIST, "first_row", "idx", "path", "cos_sim")

    old = live_best(spark, base).join(sections.select(*asked), asked, "left_semi")
    standing = sections.join(fresh_sections, "section_name", "left_anti")
    affected = stored(changes.rows.select("repo_id").distinct(), "affected")
    parts, recomputed = [], 0
    if n_sections:
        parts.append(hits(after, sections.join(fresh_sections, "section_name", "left_semi")))
    if base is not None and changes.any:
        moved = vector_store.moved_files(changes).drop("born")
        gone = changes.rows.where(F.col("was").isNotNull()).select("repo_id", "path").join(moved, ["repo_id", "path"], "left_anti")
        sizes = before.where(F.col("error").isNull()).join(affected, "repo_id", "left_semi").groupBy("repo_id").agg(F.count("*").alias("n"))
        lists = old.join(affected, "repo_id", "left_semi").join(standing.select("section_name"), "section_name", "left_semi")
        judged = stored(maintain(lists, gone, moved, hits(added, standing), sizes, depth, reserve), "judged")
        parts.append(judged.where(F.col("valid") & ~F.col("again")).drop("valid", "again"))
        again = stored(judged.where("again").select(*LIST).distinct(), "again")
        recomputed = again.count()
        if recomputed:
            vectors = after.join(again.select("repo_id").distinct(), "repo_id", "left_semi")
            found = hits(vectors, standing.join(again, "section_name", "left_semi"))
            parts.append(found.join(again, LIST, "left_semi"))
    made = spark.createDataFrame([], BEST).drop("version")
    for part in parts:
        made = made.unionByName(part)
    made = stored(made, "lists")
    # A list that is empty now has to say so, or its last version would stand.
    touched = old.join(affected, "repo_id", "left_semi").unionByName(old.join(fresh_sections, "section_name", "left_semi"))
    emptied = touched.select(*LIST, "first_row").distinct().join(made, LIST, "left_anti")
    nothing = emptied.withColumns({"idx": F.lit(None).cast("long"), "path": F.lit(None).cast("string"), "cos_sim": F.lit(None).cast("double")})
    written = made.unionByName(nothing).withColumn("version", F.lit(version).cast("long"))
    tables["best"] = (*(base.tables.get("best", ()) if base else ()), write_part(written, path, "best"))
    if n_sections or base is None:
        tables["sections"] = (write_part(sections, path, "sections"),)
    if len(tables["best"]) > MAX_FOLDERS:
        tables["best"] = (write_part(live_best(spark, Snapshot(path.rstrip("/"), version, tables)), path, "best"),)
    tables = vector_store.compacted(spark, path, tables)
    done = publish(spark, path, base, tables, note)
    return Refresh(done, changes.added + changes.changed, changes.moved, changes.removed, n_sections, recomputed)


def kept_hits(spark: SparkSession, snapshot: Snapshot, depth: int) -> DataFrame:
    """Hits of ``depth`` as ``nearest`` gives them, read from the lists."""
    held = json.loads(snapshot.note)["depth"]
    if depth > held:
        raise ValueError(f"the store keeps lists for a depth of {held}")
    sections = snapshot.read(spark, "sections", SECTIONS).select("section_name", "first_row")
    rows = live_best(spark, snapshot).where(F.col("idx").isNotNull()).join(sections, ["section_name", "first_row"], "left_semi")
    ranked = rows.withColumn("rk", F.row_number().over(Window.partitionBy(*LIST).orderBy(_place()))).where(F.col("rk") <= depth)
    return ranked.drop("version").withColumn("distance", angular_distance(F.col("cos_sim")))


def match_kept(
    spark: SparkSession,
    path: str,
    files: DataFrame,
    requirements: DataFrame,
    model: Model,
    depth: int = DEPTH,
    min_distance: float | None = MIN_DISTANCE,
    min_score: float | None = None,
    pairing: str = "aligned",
) -> DataFrame:
    """``match_single`` from the store in ``path``, refreshed first."""
    done = refresh(spark, path, files, requirements, model, depth)
    results = single_results(kept_hits(spark, done.snapshot, depth), min_distance, min_score, pairing)
    return complete_results(results, files.select("repo_id"), first_rows(clean_requirements(requirements)))
