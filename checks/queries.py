"""One query per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from traceline.functions.codec import encode_blob
from traceline.functions.text import base_name, is_source_file
from traceline.operators import approximate, documents, embed, evaluate, hits, index, knn, nest, pivots, requirements
from traceline.operators.ranking import number_files
from traceline.plans import evaluation, kept_match, match, search
from traceline.runtime import fresh_path, stored
from traceline.sources import readers, writers
from traceline.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

A, B, PICKY = fx.MODEL_A, fx.MODEL_B, fx.MODEL_PICKY
DEPTHS = (3, 20)
LSH = approximate.ProbePlan(hashes=6, tables=4, probes=3)


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def r6(name: str) -> F.Column:
    return F.round(F.col(name), 6).alias(name)


def weights(df: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    exploded = df.select(*keys, F.posexplode(vector).alias("bucket", "weight"))
    return exploded.select(*keys, "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def digest(text: F.Column) -> F.Column:
    """A number of 32 bits that sums well."""
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("long")


def _sum_of(values: F.Column, number) -> F.Column:
    return F.aggregate(F.transform(values, number), F.lit(0).cast("long"), lambda a, x: a + x)


# Sources


@query
def src_repo_tree(spark, sf):
    path = fresh_path(spark, "tree")
    writers.write_repo_tree(fx.files(spark, sf), path)
    return number_files(readers.read_repo_tree(spark, path)).select("repo_id", "idx", "path", "content")


@query
def src_repo_tree_ranges(spark, sf):
    """The same objects in ranges of 16 KiB, most of which begin inside an entry."""
    path = fresh_path(spark, "tree")
    writers.write_repo_tree(fx.files(spark, sf), path)
    rows = stored(readers.read_repo_tree(spark, path, range_bytes=16_384), "entries")
    return number_files(rows).select("repo_id", "idx", "path", "content")


@query
def src_payload(spark, sf):
    path = fresh_path(spark, "payload")
    writers.write_payloads(fx.files(spark, sf), path)
    rows = readers.read_payload(spark, path, multiline=False)
    return number_files(rows).select("repo_id", "idx", "path", "content")


@query
def src_files(spark, sf):
    return fx.files(spark, sf).select("repo_id", "path", "content")


@query
def src_requirements(spark, sf):
    path = fresh_path(spark, "requirements")
    writers.write_requirements(fx.requirements(spark, sf), path)
    return readers.read_requirements(spark, path)


@query
def src_directory(spark, sf):
    path = fresh_path(spark, "directory")
    fx.files(spark, sf).select("repo_id", F.col("content").alias("value")).write.partitionBy("repo_id").text(path)
    texts = readers.read_directory(spark, path, recursive=True)
    folder = F.regexp_extract("path", "^repo_id=([^/]*)/", 1)
    lines = F.filter(F.split("content", "\n"), lambda x: x != "")
    return texts.groupBy(folder.alias("folder")).agg(
        F.sum(F.length("content")).alias("n_chars"),
        F.sum(F.regexp_count(F.col("content"), F.lit("\n"))).alias("n_lines"),
        F.sum(_sum_of(lines, digest)).alias("digest"),
    )


@query
def src_results(spark, sf):
    return _written_results(spark, sf).select("model", "section_name", "kind", "pos", "file_name", r6("score"))


@query
def src_metrics(spark, sf):
    path = fresh_path(spark, "metrics")
    writers.write_metrics(evaluate.with_metrics(_confusion(spark, sf)), path)
    return readers.read_metrics(spark, path).select(
        "section_name", "TP", "FP", "TN", "FN", *[r6(c) for c in METRIC_NAMES]
    )


@query
def file_contents(spark, sf):
    files = fx.files(spark, sf)
    found = documents.file_contents(_search(spark, sf), files.where(is_source_file(F.col("path"))))
    return found.select("query_id", "rk", "path", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest"))


# Repository side


@query
def filter_extension(spark, sf):
    return fx.files(spark, sf).where(is_source_file(F.col("path"))).select("repo_id", "path")


@query
def decode_repo(spark, sf):
    return _decoded(spark, sf).select("repo_id", "pos", "path", "content")


@query
def decoded_files(spark, sf):
    path = fresh_path(spark, "decoded")
    writers.write_files(_decoded(spark, sf), path)
    return spark.read.schema("pos long, path string, content string, repo_id string").parquet(path)


@query
def basename(spark, sf):
    return fx.files(spark, sf).select("path", base_name(F.col("path")).alias("file_name"))


@query
def index_numbering(spark, sf):
    names = stored(embed.embedded_ok(_embedded(spark, sf, PICKY)).select("repo_id", "pos", "path"), "embedded")
    return number_files(names).select("repo_id", "idx", "path")


# Requirement side


@query
def clean_requirements(spark, sf):
    return requirements.clean_requirements(fx.requirements(spark, sf))


@query
def distinct_sections(spark, sf):
    return requirements.distinct_sections(requirements.clean_requirements(fx.requirements(spark, sf)))


@query
def section_queries(spark, sf):
    return requirements.section_queries(requirements.clean_requirements(fx.requirements(spark, sf)))


# Embedding and index


@query
def embed_hash(spark, sf):
    return weights(embed.embed(fx.files(spark, sf), "content", A), "repo_id", "path")


@query
def embed_loaded(spark, sf):
    """A model of one's own, loaded in the workers."""
    return weights(embed.embed(fx.files(spark, sf), "content", fx.MODEL_LETTERS), "repo_id", "path")


@query
def embed_two_models(spark, sf):
    both = stored(embed.embed_two_models(fx.files(spark, sf), "content", PICKY, B), "both")
    first = weights(both, "repo_id", "path", vector="embedding_1").withColumn("model", F.lit(PICKY.name))
    second = weights(both, "repo_id", "path", vector="embedding_2").withColumn("model", F.lit(B.name))
    return first.unionByName(second)


@query
def embed_queries(spark, sf):
    return weights(search.embed_queries(fx.query_texts(spark, sf), A, ["query_id"]), "query_id")


@query
def embed_ok(spark, sf):
    return embed.embedded_ok(_embedded(spark, sf, PICKY)).select("repo_id", "model", "path", "dim")


@query
def failed_files(spark, sf):
    return embed.failed_files(_embedded(spark, sf, PICKY))


@query
def run_counts(spark, sf):
    return embed.run_counts(_embedded(spark, sf, PICKY))


@query
def run_totals(spark, sf):
    """Counts that the embedding pass itself gives."""
    counts = Observation("run")
    index.write_index(index.build_index(fx.files(spark, sf), PICKY, counts), fresh_path(spark, "index"))
    found = counts.get
    return spark.createDataFrame([tuple(found[c] for c in RUN_COLUMNS)], ", ".join(f"{c} long" for c in RUN_COLUMNS))


@query
def index_roundtrip(spark, sf):
    return weights(_written_index(spark, sf), "repo_id", "model", "idx", "path", "dim")


@query
def index_map(spark, sf):
    return index.index_map(_written_index(spark, sf))


@query
def total_files(spark, sf):
    return index.total_files(_written_index(spark, sf))


@query
def build_or_load(spark, sf):
    """A store of the documents, the French ones outdated, brought up to date."""
    files = fx.files(spark, sf)
    french = F.col("path").endswith(".py")
    old = files.where(F.col("repo_id") != "web").withColumn(
        "content", F.when(french, F.concat("content", F.lit(" old"))).otherwise(F.col("content"))
    )
    store = stored(index.build_or_load(old, None, A), "store")
    held = store.select("repo_id", "path", "digest", F.lit(1).alias("reused"))
    fresh = index.build_or_load(files, store, A)
    return weights(
        fresh.join(held, ["repo_id", "path", "digest"], "left").withColumn("reused", F.coalesce("reused", F.lit(0))),
        "repo_id", "path", "digest", "reused",
    )


# Neighbours


@query
def knn_topk(spark, sf):
    return _neighbours(spark, sf).select("q", "rk", "idx", "path", r6("distance"))


@query
def knn_topk_block(spark, sf):
    found = knn.nearest_blocked(
        fx.vectors(spark, sf), fx.vector_queries(spark, sf), 4, 64, ["repo_id"], ["q"], ["path"], block_rows=64
    )
    return found.select("q", "rk", "idx", "path", r6("distance"))


@query
def knn_topk_pivot(spark, sf):
    path = fresh_path(spark, "pivots")
    pivots.build_pivots(fx.vectors(spark, sf), 64, ["repo_id"], ["path"], count=16, ring_rows=64, path=path)
    found = pivots.nearest_pivots(pivots.read_pivots(spark, path), fx.vector_queries(spark, sf), 4, 64, by=["q"])
    return found.select("q", "rk", "idx", "path", r6("distance"))


@query
def knn_full_rank(spark, sf):
    found = knn.nearest(fx.vectors(spark, sf), fx.vector_sections(spark, sf), None, 64)
    return knn.rank_all(found).select("section_name", "rk", "idx", r6("distance"))


@query
def knn_lsh(spark, sf):
    """A given plan, which SQL can repeat, through a written index."""
    path = fresh_path(spark, "buckets")
    approximate.build_buckets(fx.vectors(spark, sf), 64, LSH, ["repo_id"], ["path"], path=path)
    found = approximate.search_buckets(
        approximate.read_buckets(spark, path), fx.vector_queries(spark, sf), 4, ["repo_id"], ["q"], ["path"]
    )
    return found.select("q", "rk", "idx", "path", r6("distance"))


@query
def score(spark, sf):
    return hits.with_score(_neighbours(spark, sf)).select("q", "rk", "idx", r6("distance"), r6("score"))


@query
def threshold_aligned(spark, sf):
    return hits.threshold_aligned(_neighbours(spark, sf)).select("q", "rk", "idx", r6("score"))


@query
def threshold_positional(spark, sf):
    found = stored(_neighbours(spark, sf), "hits")
    return hits.threshold_positional(found, key=["q"]).select("q", "rk", "idx", r6("score"))


@query
def search_listing(spark, sf):
    return _search(spark, sf).select("query_id", "rk", "path", r6("distance"))


# Result algebra


@query
def dedupe_basename(spark, sf):
    scored = hits.threshold_aligned(_section_hits(spark, sf, "vec_a", 20))
    return hits.dedupe_basename(scored, ["section_name"]).select("section_name", "file_name", r6("score"), "pos")


@query
def model_file_scores(spark, sf):
    return _list(spark, sf, "vec_b", 20).select("section_name", "pos", "file_name", r6("score"))


@query
def common_files(spark, sf):
    both = hits.common_files(_list(spark, sf, "vec_a", 20), _list(spark, sf, "vec_b", 20), ["section_name"])
    return both.select("section_name", "pos", "file_name", r6("score"))


@query
def unique_files(spark, sf):
    one = hits.unique_files(_list(spark, sf, "vec_a", 20), _list(spark, sf, "vec_b", 20), ["section_name"])
    return one.select("section_name", "src", "pos", "file_name", r6("score"))


# Whole jobs


@query
def match_single(spark, sf):
    return _match_single(spark, sf).select(*RESULT, r6("score"))


@query
def match_kept(spark, sf):
    """A store without the web repository, the French files outdated, brought up to date."""
    path = fresh_path(spark, "kept")
    files, asked = stored(_decoded(spark, sf), "decoded"), fx.requirements(spark, sf)
    french = F.col("path").endswith(".py")
    old = files.where(F.col("repo_id") != "web").withColumn(
        "content", F.when(french, F.concat("content", F.lit(" old"))).otherwise(F.col("content"))
    )
    kept_match.refresh(spark, path, old, asked, A)
    return kept_match.match_kept(spark, path, files, asked, A).select(*RESULT, r6("score"))


@query
def match_dual(spark, sf):
    found = match.match_dual(_decoded(spark, sf), fx.requirements(spark, sf), A, B)
    return found.select(*RESULT, r6("score"))


@query
def section_result(spark, sf):
    nested = nest.nest_results(_match_single(spark, sf))
    pair = F.posexplode_outer("result.common_files").alias("at", "pair")
    return nested.select("repo_id", "section_name", F.size("result.only_one_model").alias("n_only"), pair).select(
        "repo_id", "section_name", "n_only", (F.col("at") + 1).alias("pos"), "pair.file_name", F.round("pair.score", 6).alias("score")
    )


@query
def result_json_roundtrip(spark, sf):
    path = fresh_path(spark, "section_result")
    writers.write_result_json(_match_single(spark, sf), path, depth=match.DEPTH)
    rows = readers.result_pairs(
        spark.read.schema("value string, depth int, repo_id string")
        .text(path)
        .select(
            "depth",
            "repo_id",
            F.explode(F.from_json("value", readers.schemas.RESULT_DOCUMENT)).alias("section_name", "lists"),
        )
    )
    return rows.select("depth", *RESULT, r6("score"))


@query
def combined_payload(spark, sf):
    payload = nest.combined_payload(_match_single(spark, sf), writers.encode_files(fx.files(spark, sf)))
    schema = "struct<rag_output: map<string, struct<common_files: array<array<string>>>>, repo_files: map<string, struct<content: string>>>"
    parsed = payload.select("repo_id", F.from_json("payload", schema).alias("p"))
    lists = F.transform(F.map_values("p.rag_output"), lambda s: F.size(s["common_files"]))
    sizes = F.transform(F.map_values("p.repo_files"), lambda f: F.length(F.unbase64(f["content"])))

    def total(values):
        return F.sum(F.aggregate(values, F.lit(0), lambda a, x: a + x))

    contents = F.map_entries("p.repo_files")
    named = _sum_of(contents, lambda f: digest(F.concat(f["key"], F.unbase64(f["value"]["content"]).cast("string"))))
    pairs = _sum_of(
        F.flatten(F.transform(F.map_entries("p.rag_output"), lambda s: F.transform(s["value"]["common_files"], lambda f: F.concat(s["key"], f[0])))),
        digest,
    )

    return parsed.groupBy("repo_id").agg(
        F.sum(F.size("p.rag_output")).alias("n_sections"),
        total(lists).alias("n_pairs"),
        F.sum(F.size("p.repo_files")).alias("n_files"),
        total(sizes).alias("n_bytes"),
        F.sum(named).alias("files_digest"),
        F.sum(pairs).alias("pairs_digest"),
    )


@query
def prompt_table(spark, sf):
    return _prompts(spark, sf, "task")


@query
def prompt_summary_table(spark, sf):
    return _prompts(spark, sf, "summary")


@query
def doc_context(spark, sf):
    return search.document_context(_one_numbering(spark, sf), fx.query_texts(spark, sf), A)


# Evaluation


@query
def result_pairs(spark, sf):
    rows = _written_results(spark, sf).where(F.col("kind") == "common_files")
    return rows.select("model", "section_name", "file_name", r6("score"))


@query
def eval_input(spark, sf):
    return evaluate.eval_input(_written_results(spark, sf)).select("model", "section_name", "file_name", r6("score"))


@query
def eval_retrieved(spark, sf):
    return evaluate.eval_retrieved(_written_results(spark, sf)).select("model", "section_name", "retrieved", r6("score"))


@query
def retrieve_accuracy(spark, sf):
    rows = evaluate.eval_retrieved(_written_results(spark, sf))
    return evaluate.retrieve_accuracy(rows).select("ones_count", "row_count", r6("accuracy"))


@query
def accuracy_by_model(spark, sf):
    path = fresh_path(spark, "results")
    writers.write_result_json(_model_results(spark, sf), path, by="model")
    return evaluation.accuracy_by_model(spark, path).select("model", "ones_count", "row_count", r6("accuracy"))


@query
def model_wins(spark, sf):
    return evaluate.model_wins(evaluate.eval_retrieved(_written_results(spark, sf)).withColumn("score", F.round("score", 6)))


@query
def confusion_counts(spark, sf):
    return _confusion(spark, sf)


@query
def confusion_metrics(spark, sf):
    rows = evaluate.with_metrics(_confusion(spark, sf))
    return rows.select("section_name", "TP", "FP", "TN", "FN", *[r6(c) for c in METRIC_NAMES])


@query
def metrics_summary(spark, sf):
    rows = evaluate.metrics_summary(evaluate.with_metrics(_confusion(spark, sf)))
    return rows.select(
        "sections", "TP", "FP", "TN", "FN", "perfect_sections",
        *[r6(f"{kind}_{c}") for kind in ("macro", "micro") for c in METRIC_NAMES],
    )


# Streaming


@query
def stream_match(spark, sf):
    results, _ = _stream(spark, sf)
    return spark.read.parquet(results).select(*RESULT, r6("score"))


@query
def stream_runs(spark, sf):
    _, runs = _stream(spark, sf)
    return jobs.read_runs(spark, runs).select("repo_id", "state", "error")


# Parts shared by the queries

RUN_COLUMNS = ["files_found", "files_indexed", "files_failed"]
METRIC_NAMES = ["precision", "recall", "f1_score", "specificity", "balanced_accuracy"]
RESULT = ["repo_id", "section_name", "kind", "pos", "file_name"]


def _decoded(spark, sf):
    """The files sent through encoding and decoding."""
    return readers.decode_files(writers.encode_files(fx.files(spark, sf)))


def _embedded(spark, sf, model):
    return embed.embed(fx.files(spark, sf), "content", model)


def _written_index(spark, sf):
    path = fresh_path(spark, "index")
    index.write_index(index.build_index(fx.files(spark, sf), PICKY), path)
    return index.read_index(spark, path, model=PICKY)


def _neighbours(spark, sf):
    return knn.nearest(fx.vectors(spark, sf), fx.vector_queries(spark, sf), 4, 64, by=["q"])


def _one_numbering(spark, sf):
    """The files with positions that tell those of all repositories apart."""
    web = F.col("repo_id") == "web"
    return fx.files(spark, sf).withColumn("pos", F.col("pos") * 2 + F.when(web, 1).otherwise(0))


def _search(spark, sf):
    files = _one_numbering(spark, sf).withColumnRenamed("pos", "idx")
    embedded = embed.embedded_ok(embed.embed(files, "content", A))
    return search.search(embedded, fx.query_texts(spark, sf), A, scope=[], keep=["repo_id", "path"])


def _prompts(spark, sf, style):
    files = fx.files(spark, sf)
    prompts = documents.prompt_table(_search(spark, sf), files, fx.query_texts(spark, sf), style)
    return prompts.select("query_id", "rk", "path", "prompt")


def _section_hits(spark, sf, model, depth):
    return knn.nearest(
        fx.vectors(spark, sf, model), fx.vector_sections(spark, sf, model), depth, fx.VECTOR_DIMS[model],
        by=["section_name", "first_row"],
    )


def _list(spark, sf, model, depth):
    return hits.model_file_scores(hits.threshold_aligned(_section_hits(spark, sf, model, depth)), ["section_name"])


def _match_single(spark, sf):
    return match.match_single(_decoded(spark, sf), fx.requirements(spark, sf), A)


def _model_results(spark, sf):
    """Long results of six set-ups: two models and their combination, two depths.

    The set-up takes the place of the repository, so all six are one job.
    """
    found = {m: stored(_section_hits(spark, sf, m, max(DEPTHS)), "hits") for m in fx.VECTOR_DIMS}

    def at_depths(model: str, name: str) -> DataFrame:
        setups = F.array(*[F.when(F.col("rk") <= d, F.lit(f"{name}_top{d}")) for d in DEPTHS])
        return found[model].withColumn("repo_id", F.explode(F.array_compact(setups)))

    single = match.single_results(at_depths("vec_a", "vec_a").unionByName(at_depths("vec_b", "vec_b")))
    dual = match.dual_results(at_depths("vec_a", "dual"), at_depths("vec_b", "dual"), depth=max(DEPTHS))
    return single.unionByName(dual)


def _written_results(spark, sf):
    path = fresh_path(spark, "results")
    writers.write_result_json(_model_results(spark, sf), path, by="model")
    return readers.read_results(spark, path)


def _confusion(spark, sf):
    """The 20 nearest files of each section against the files of its label."""
    found = _section_hits(spark, sf, "vec_a", 20).select("section_name", F.col("path").alias("file_name"))
    universe = fx.vectors(spark, sf).select(F.col("path").alias("file_name"))
    label = F.regexp_extract("file_name", r"/(f[0-9]+)\.php$", 1)
    relevant = universe.select(label.alias("section_name"), "file_name")
    return evaluate.confusion_counts(found, relevant, universe)


def _stream(spark, sf):
    """Payload files, those of the web repository damaged, run as a stream."""
    inbox, results, runs, checkpoint = (fresh_path(spark, n) for n in ("inbox", "results", "runs", "checkpoint"))
    damaged = F.when(F.col("repo_id") == "web", F.concat(encode_blob(F.col("content")), F.lit("A"))).otherwise(
        encode_blob(F.col("content"))
    )
    writers.write_encoded_payloads(fx.files(spark, sf).withColumn("content", damaged), inbox)
    stream = jobs.match_stream(
        jobs.read_payload_stream(spark, inbox), fx.requirements(spark, sf), A, results, runs, checkpoint
    )
    stream.awaitTermination()
    return results, runs
