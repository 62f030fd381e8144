"""The registered query of every operator, on the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceline.llm import (
    bpe,
    exact_topk,
    fingerprints,
    html_extract,
    packing,
    prefix_trie,
    quality_rules,
    simhash_dedup,
    suffix_dedup,
    token_files,
    toxicity,
    url_filter,
    whitening,
)
from traceline.runtime import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded and decoded with the byte-level ranks."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf, "documents"), path, public_tokenizers.PATTERN)


@query
def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's pieces and their places in the packed sequences."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.cut_documents(table(spark, sf, "documents"), path, with_ids=False))


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's toxicity, learned from the labelled rows outside fold 0."""
    docs = table(spark, sf, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf, "labels")))


@query
def op10_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = simhash_dedup.near_components(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without the strings of earlier ones."""
    found = suffix_dedup.remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's statistics and verdict."""
    docs = table(spark, sf, "documents")
    rules = quality_rules.train(docs, table(spark, sf, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.judge(docs.select("doc_id", "text"), rules).select("doc_id", *counts, "base_failed", "kept", "rule")


@query
def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "p_block")


@query
def op7_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's fingerprint beside its edited text's and the next document's."""
    found = fingerprints.edit_report(table(spark, sf, "documents"))

    def shown(name: str, into: str):
        return F.lpad(F.lower(F.hex(name)), 16, "0").alias(into)

    prints = [shown("fp", "fingerprint"), shown("edited_fp", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", "edited_sha256", *prints, "near_edited", "near_next")


@query
def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids written to files and read back."""
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path, with_ids=False)


@query
def op9_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf, "pages"))


@query
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf, "conversations"))


@query
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """The four whitened principal components of every vector."""
    return whitening.whiten(table(spark, sf, "embeddings"))


@query
def op13_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty greatest inner products of every twentieth vector with all others."""
    vectors = table(spark, sf, "embeddings")
    return exact_topk.top_products(vectors, vectors.where(F.col("vec_id") % 20 == 0))
