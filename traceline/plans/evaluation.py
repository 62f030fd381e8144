"""Evaluation of result files and confusion reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceline.operators.evaluate import (
    EXPECTED_SUFFIX,
    confusion_counts,
    eval_retrieved,
    retrieve_accuracy,
    with_metrics,
)
from traceline.sources.readers import read_results


def accuracy_by_model(spark: SparkSession, path: str | list[str], suffix: str = EXPECTED_SUFFIX, layout: str = "lines") -> DataFrame:
    """Retrieval accuracy of every model whose results are under ``path``."""
    return retrieve_accuracy(eval_retrieved(read_results(spark, path, layout), suffix), ["model"])


def confusion_report(retrieved: DataFrame, relevant: DataFrame, universe: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Counts and metrics per section; ``sections`` names those that are in the report whatever was found."""
    return with_metrics(confusion_counts(retrieved, relevant, universe, sections=sections))
