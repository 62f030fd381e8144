"""Repository payloads that arrive over time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from traceline import schemas
from traceline.functions.scoring import angular_distance
from traceline.operators.embed import Model, embed
from traceline.operators.hits import MIN_DISTANCE
from traceline.operators.knn import best_task
from traceline.operators.requirements import clean_requirements, first_rows, section_vectors
from traceline.plans.match import DEPTH, complete_results, single_results
from traceline.runtime import stored
from traceline.sources.readers import decode_files, explode_payload
from traceline.streaming.state import EVENTS, HIT, OUTCOMES, RepositoryJob

PATIENCE_MS = 3_600_000  # how long a repository waits for its missing parts
MAX_SECTIONS = 65_536  # sections of a requirements catalogue, which every task of a stream holds
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN_SCHEMA = "repo_id string, state string, error string, batch_id long"


def read_payload_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Payloads as they arrive, with the file they came in."""
    reader = spark.readStream.schema(schemas.PAYLOAD)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file"))


def run_states(payload: DataFrame, decoded: DataFrame) -> DataFrame:
    """SUCCESS or FAILURE with the first error, one row per repository.

    ``decoded`` has the ``error`` column of ``decode_files(on_error='null')``. A
    payload without an id, or a line that is no payload at all, is a FAILURE.
    """
    failed = (
        decoded.where(F.col("error").isNotNull())
        .groupBy("repo_id")
        .agg(F.min(F.concat("path", F.lit(": "), "error")).alias("error"))
    )
    return (
        payload.select(F.col("id").alias("repo_id"))
        .distinct()
        .join(failed, "repo_id", "left")
        .withColumn("error", F.when(F.col("repo_id").isNull(), "not a payload with an id").otherwise(F.col("error")))
        .select("repo_id", F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILURE").alias("state"), "error")
    )


def job_events(payloads: DataFrame, sections: DataFrame, model: Model, depth: int) -> DataFrame:
    """Rows of ``state.EVENTS``: the parts that came, their bad files, and each task's best files per section.

    Files are decoded, embedded and scored where they arrive; only ``depth``
    hits per section and task go on. A payload without an id is a job of its
    own, told from others by the file it came in.
    """
    nameless = F.concat(F.lit("not a payload with an id: "), F.substring_index("file", "/", -1))
    job = F.coalesce(F.concat(F.lit("id "), "id"), F.concat(F.lit("file "), "file"))
    no = {c: F.lit(None).cast(t) for c, t in (e.split() for e in EVENTS.split(", "))}

    def events(rows: DataFrame, **known: Column) -> DataFrame:
        return rows.select(*[{**no, **known}[c].alias(c) for c in no])

    parts = events(payloads, job=job, repo_id=F.col("id"), kind=F.lit("part"), part=F.col("part"), parts=F.col("parts"))
    bad_payloads = events(payloads.where(F.col("id").isNull()), job=job, kind=F.lit("error"), error=nameless)
    tree = explode_payload(payloads.where(F.col("id").isNotNull()))
    decoded = decode_files(tree, on_error="null", spread=True).withColumnRenamed("error", "bad")
    found = embed(decoded.withColumnRenamed("pos", "idx"), "content", model)
    judged = events(
        _hits_and_errors(found, sections, model, depth),
        job=F.concat(F.lit("id "), "repo_id"),
        repo_id=F.col("repo_id"),
        kind=F.when(F.col("bad").isNull(), "hit").otherwise("error"),
        error=F.concat("path", F.lit(": "), "bad"),
        **{c: F.col(c) for c in HIT},
    )
    return parts.unionByName(bad_payloads).unionByName(judged)


def _hits_and_errors(found: DataFrame, sections: DataFrame, model: Model, depth: int) -> DataFrame:
    """The best files of each task, and its files that could not be read, from one pass over the payloads."""
    by = ["section_name", "first_row"]
    matrix = sections.where(F.col("embedding").isNotNull()).select(*by, "embedding").limit(MAX_SECTIONS + 1).toArrow()
    if matrix.num_rows > MAX_SECTIONS:
        raise ValueError(f"more than {MAX_SECTIONS} sections; a stream sends all of them to every task")
    best = best_task(found.sparkSession, matrix, depth, model.dim, ["repo_id"], by, ["path"])
    out = "repo_id string, idx long, path string, section_name string, first_row long, cos_sim double, bad string"
    schema = to_arrow_schema(T.StructType.fromDDL(out))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad: list[pa.RecordBatch] = []

        def good() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                failed = pc.is_valid(batch.column("bad"))
                # Names and reasons only, at most one for each file the task was given.
                bad.append(batch.filter(failed).select(["repo_id", "idx", "path", "bad"]))
                yield batch.filter(pc.and_(pc.invert(failed), pc.is_valid(batch.column("embedding"))))

        def padded(rows: pa.RecordBatch) -> pa.RecordBatch:
            columns = [rows.column(f.name).cast(f.type) if f.name in rows.schema.names else pa.nulls(rows.num_rows, f.type) for f in schema]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for part in best(good()):
            yield padded(part)
        for part in bad:
            yield padded(part)

    return found.select("repo_id", "idx", "path", "bad", "embedding").mapInArrow(task, out)


def match_stream(
    payloads: DataFrame,
    requirements: DataFrame,
    model: Model,
    results_path: str,
    runs_path: str,
    checkpoint: str,
    depth: int = DEPTH,
    min_distance: float | None = MIN_DISTANCE,
    every: str | None = None,
    patience_ms: int = PATIENCE_MS,
) -> StreamingQuery:
    """Match every arriving repository; one set of results and one state row per repository.

    A repository may come in several parts and batches (``part`` of ``parts``);
    its best files are kept as state until the last part is there (see
    ``state.RepositoryJob``). A file that cannot be decoded, or a part that is
    missing after ``patience_ms``, makes the job a FAILURE and the others go on:
    bad files are data here, not exceptions. Waiting is looked at when a batch
    runs, which without ``every`` needs new payloads. Each batch replaces its own
    ``batch_id`` partition, so a repeated batch adds nothing. What has arrived
    is worked off once, or with ``every`` (such as "1 minute") looked for again
    and again; an unfinished repository waits in the checkpoint in between.
    """
    spark = payloads.sparkSession
    cleaned = clean_requirements(requirements)
    sections, rows = stored(section_vectors(cleaned, model), "sections"), stored(first_rows(cleaned), "section-rows")
    outcomes = (
        job_events(payloads, sections, model, depth)
        .groupBy("job")
        .transformWithState(RepositoryJob(depth, patience_ms), OUTCOMES, "Update", "ProcessingTime")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        # Reading the batch advances the state: it is read once.
        done = stored(batch, "outcomes")
        if done.isEmpty():
            return
        states = done.where(F.col("section_name").isNull()).select("repo_id", "state", "error")
        key = ["repo_id", "section_name", "first_row"]
        place = Window.partitionBy(*key).orderBy(F.col("cos_sim").desc(), "idx")
        hits = done.where(F.col("section_name").isNotNull()).select(
            *key, "idx", "path", "cos_sim", angular_distance(F.col("cos_sim")).alias("distance"), F.row_number().over(place).alias("rk")
        )
        good = states.where(F.col("state") == "SUCCESS")
        _replace(complete_results(single_results(hits, min_distance), good, rows), results_path, batch_id)
        # Last, so that a state is only there when its results are.
        _replace(states, runs_path, batch_id)

    writer = outcomes.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", checkpoint)
    # Keyed state with timers needs this store. A query that is to end must not wait for timers in empty batches.
    with _settings(spark, {PROVIDER: STATE_STORE, EMPTY_BATCHES: str(every is not None).lower()}):
        return writer.trigger(**({"availableNow": True} if every is None else {"processingTime": every})).start()


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for the start of a query, which takes a copy of them."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _replace(df: DataFrame, path: str, batch_id: int) -> None:
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)
