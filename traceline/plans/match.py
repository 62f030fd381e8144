"""Repositories against requirement sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceline.functions.scoring import angular_distance
from traceline.functions.text import base_name
from traceline.operators.embed import Model, embed, embed_two_models, embedded_ok
from traceline.operators.hits import (
    KEY,
    MIN_DISTANCE,
    merge_complete,
    merge_distances,
    model_file_scores,
    passes,
    threshold_positional,
    with_score,
)
from traceline.operators.knn import nearest, score_both
from traceline.operators.ranking import number_rows
from traceline.operators.requirements import clean_requirements, first_rows, section_vectors
from traceline.runtime import stored

SECTION_BLOCK = 1024  # sections that travel together to a repository
RESULT_COLUMNS = ["repo_id", "section_name", "first_row", "kind", "pos", "file_name", "score"]
DEPTH = 3


def match_single(
    files: DataFrame,
    requirements: DataFrame,
    model: Model,
    depth: int = DEPTH,
    min_distance: float | None = MIN_DISTANCE,
    min_score: float | None = None,
    pairing: str = "aligned",
    repos: DataFrame | None = None,
) -> DataFrame:
    """Every repository against every section with one model.

    ``files`` holds ``repo_id, pos, path, content``. All repositories and all
    sections are one job: the files are embedded and scored where they are
    read, and only the best ``depth`` of each batch are shuffled. A repository
    of ``repos`` (by default those with files) and a section of the
    requirements that have nothing to be matched by get rows without a file.
    """
    cleaned = clean_requirements(requirements)
    results = match_sections(files, section_vectors(cleaned, model), model, depth, min_distance, min_score, pairing)
    return complete_results(results, repos if repos is not None else files, first_rows(cleaned))


def complete_results(results: DataFrame, repos: DataFrame, sections: DataFrame) -> DataFrame:
    """Add a row without a file for every repository and section that have no row.

    ``sections`` holds each ``section_name`` once, with its ``first_row``. The
    sections travel in blocks, which a repository meets by their numbers and
    without any file; the pairs are part of the result.
    """
    sections = stored(sections.select("section_name", "first_row"), "sections")
    blocks = max(1, -(-sections.count() // SECTION_BLOCK))
    packed = sections.groupBy(F.pmod(F.xxhash64("section_name"), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct("section_name", "first_row")).alias("_sections")
    )
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    every = repos.select("repo_id").distinct().withColumn("_block", numbers).join(packed, "_block")
    pairs = every.select("repo_id", F.explode("_sections").alias("_s")).select(
        "repo_id", F.col("_s.section_name").alias("section_name"), F.col("_s.first_row").alias("_row")
    )
    met = pairs.join(results, ["repo_id", "section_name"], "full")
    return met.withColumn("first_row", F.coalesce("first_row", "_row")).select(*RESULT_COLUMNS)


def match_sections(
    files: DataFrame,
    sections: DataFrame,
    model: Model,
    depth: int = DEPTH,
    min_distance: float | None = MIN_DISTANCE,
    min_score: float | None = None,
    pairing: str = "aligned",
) -> DataFrame:
    """``match_single`` for section vectors at hand."""
    index = embedded_ok(embed(files.withColumnRenamed("pos", "idx"), "content", model))
    hits = nearest(index, sections, depth, model.dim, by=["section_name", "first_row"])
    return single_results(hits, min_distance, min_score, pairing)


def single_results(
    hits: DataFrame,
    min_distance: float | None = MIN_DISTANCE,
    min_score: float | None = None,
    pairing: str = "aligned",
) -> DataFrame:
    """Hits of one model to the result table; groups are at most ``depth`` rows."""
    key = [*KEY, "first_row"]
    if pairing == "aligned":
        kept = passes(min_distance, min_score)
        # A hit below the threshold stays as a row without file, so that its
        # section is known when nothing else is left of it.
        scored = with_score(hits).withColumn("_kept", kept)
        files = scored.groupBy(*key, F.when(F.col("_kept"), base_name(F.col("path"))).alias("file_name")).agg(
            F.max_by("score", "rk").alias("score"), F.min("rk").alias("rk")
        )
    elif pairing == "positional":
        hits = stored(hits, "hits")
        scored = threshold_positional(hits, min_distance if min_distance is not None else -1.0, key)
        files = model_file_scores(scored, key).withColumnRenamed("pos", "rk")
        sections = hits.select(*key).distinct()
        files = files.unionByName(
            sections.select(
                *key,
                F.lit(None).cast("int").alias("rk"),
                F.lit(None).cast("string").alias("file_name"),
                F.lit(None).cast("double").alias("score"),
            )
        )
    else:
        raise ValueError(f"unknown pairing {pairing!r}")
    return _drop_fillers(files, key)


def _drop_fillers(files: DataFrame, key: list[str]) -> DataFrame:
    """Number the files of a section; keep the empty row only where it is alone."""
    by_section = Window.partitionBy(*key)
    named = F.col("file_name").isNotNull()
    return (
        files.withColumn("_any", F.max(named).over(by_section))
        .where(named | ~F.col("_any"))
        .withColumn("pos", F.when(named, F.row_number().over(by_section.orderBy("rk"))))
        .withColumn("score", F.when(named, F.col("score")))
        .withColumn("kind", F.when(named, F.lit("common_files")))
        .select(*RESULT_COLUMNS)
    )


def match_dual(
    files: DataFrame,
    requirements: DataFrame,
    first: Model,
    second: Model,
    min_distance: float | None = MIN_DISTANCE,
    repos: DataFrame | None = None,
    depth: int | None = None,
) -> DataFrame:
    """Two models' rankings combined into common and single files.

    The rankings are complete, or end after ``depth`` files; then no more than
    that many files per section leave a task. Both vectors of a file are made
    and scored in one pass. As in ``match_single`` every repository and section
    has a row.
    """
    embedded = embed_two_models(files.withColumnRenamed("pos", "idx"), "content", first, second).select(
        "repo_id", "idx", base_name(F.col("path")).alias("path"), "embedding_1", "embedding_2"
    )
    cleaned = clean_requirements(requirements)
    by = ["section_name", "first_row"]
    one, two = section_vectors(cleaned, first), section_vectors(cleaned, second)
    if depth is not None:
        index = stored(embedded, "vectors")

        def short(vectors: DataFrame, model: Model, vector: str) -> DataFrame:
            side = index.select("repo_id", "idx", "path", F.col(vector).alias("embedding"))
            return nearest(side, vectors, depth, model.dim, by=by)

        results = dual_results(short(one, first, "embedding_1"), short(two, second, "embedding_2"), min_distance, depth)
    else:
        both = one.withColumnRenamed("embedding", "embedding_1").join(two.withColumnRenamed("embedding", "embedding_2"), by, "full")
        scored = score_both(embedded, both, (first.dim, second.dim), ["repo_id"], by, ["path"])

        def counted(cosine: str) -> Column:
            distance = angular_distance(F.col(cosine))
            return F.when(distance > min_distance, distance) if min_distance is not None else distance

        pairs = scored.select(*KEY, "first_row", F.col("path").alias("file_name"), counted("cos_1").alias("d1"), counted("cos_2").alias("d2"))
        results = _listed(merge_distances(pairs))
    return complete_results(results, repos if repos is not None else files, first_rows(cleaned))


def dual_results(
    first: DataFrame, second: DataFrame, min_distance: float | None = MIN_DISTANCE, depth: int | None = None
) -> DataFrame:
    """Two rankings to the result table.

    Without a depth the rankings are complete and a list may hold every file of
    a repository, so lists are numbered by range; with one they are short.
    """
    section, key, order = [*KEY, "first_row"], [*KEY, "first_row", "kind"], ["src", "near", "file_name"]
    merged = merge_complete(first, second, min_distance)
    if depth is None:
        return _listed(merged)
    by_section = Window.partitionBy(*section)
    listed = (
        merged.withColumn("_any", F.max("kept").over(by_section))
        .withColumn("_n", F.row_number().over(by_section.orderBy(F.col("kept").desc(), "file_name")))
        .where(F.col("kept") | (~F.col("_any") & (F.col("_n") == 1)))
        .withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long"))
    )
    values = [F.when(F.col("kept"), F.col(c)).alias(c) for c in ("kind", "pos", "file_name", "score")]
    return listed.select(*section, *values).select(*RESULT_COLUMNS)


def _listed(merged: DataFrame) -> DataFrame:
    """Numbers for lists that may hold every file of a repository."""
    section, key, order = [*KEY, "first_row"], [*KEY, "first_row", "kind"], ["src", "near", "file_name"]
    # Read three times below; scoring everything again would cost more.
    merged = stored(merged, "merged")
    listed = number_rows(merged.where("kept").drop("kept"), key, order, "pos")
    empty = (
        merged.groupBy(*section)
        .agg(F.max("kept").alias("kept"))
        .where(~F.col("kept"))
        .select(
            *section,
            F.lit(None).cast("string").alias("kind"),
            F.lit(None).cast("long").alias("pos"),
            F.lit(None).cast("string").alias("file_name"),
            F.lit(None).cast("double").alias("score"),
        )
    )
    return listed.select(*RESULT_COLUMNS).unionByName(empty)
