"""Requirement rows to one query per section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceline.functions.text import is_active, without_parentheses
from traceline.operators.embed import HashModel, Model, embed, sum_counts
from traceline.operators.ranking import number_rows

SECTION_CHUNK = 4096  # rows of a section concatenated in one step


def clean_requirements(requirements: DataFrame) -> DataFrame:
    """Withdrawn and NULL requirements out, parenthesised remarks removed."""
    return requirements.where(
        F.col("section_name").isNotNull() & is_active(F.col("req_description"))
    ).withColumn("req_description", without_parentheses(F.col("req_description")))


def dropped_requirements(requirements: DataFrame) -> DataFrame:
    """Count the rows ``clean_requirements`` leaves out, by reason."""
    return requirements.agg(
        F.count_if(F.col("section_name").isNull()).alias("no_section"),
        F.count_if(F.col("req_description").isNull()).alias("no_description"),
        F.count_if(~is_active(F.col("req_description"))).alias("deleted"),
    )


def first_rows(cleaned: DataFrame) -> DataFrame:
    """Sections with the row they first appear in; the order of the output."""
    return cleaned.groupBy("section_name").agg(F.min("row_idx").alias("first_row"))


def distinct_sections(cleaned: DataFrame) -> DataFrame:
    """Sections numbered from 0 in first-seen order."""
    return number_rows(first_rows(cleaned), [], ["first_row"], "section_idx", start=0)


def section_queries(cleaned: DataFrame) -> DataFrame:
    """Requirements of a section joined by one blank in row order.

    Runs of rows are joined first and the runs of a section after, so no task
    sorts a whole section; only the finished text is one row.
    """
    runs = cleaned.groupBy("section_name", F.floor(F.col("row_idx") / SECTION_CHUNK).alias("run")).agg(
        F.expr("listagg(req_description, ' ') within group (order by row_idx)").alias("text"),
        F.min("row_idx").alias("first_row"),
    )
    return runs.groupBy("section_name").agg(
        F.min("first_row").alias("first_row"),
        F.expr("listagg(text, ' ') within group (order by run)").alias("query_text"),
    )


def section_vectors(cleaned: DataFrame, model: Model) -> DataFrame:
    """``section_name, first_row, embedding`` of every section query."""
    if isinstance(model, HashModel):
        vectors = sum_counts(cleaned, "req_description", "section_name", model)
        return vectors.join(first_rows(cleaned), "section_name")
    return embed(section_queries(cleaned), "query_text", model).select("section_name", "first_row", "embedding")
