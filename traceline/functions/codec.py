"""Base64 and UTF-8 decoding with errors as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_STRAY = "[^A-Za-z0-9+/=]"
# One greedy run over the text, where a search for a stray would start anew at
# every character.
_NO_STRAY = r"^[A-Za-z0-9+/]*+=*+\z"


def with_decoded(df: DataFrame, content: str, text: str, error: str) -> DataFrame:
    """Add ``text`` and ``error`` of a base64 column.

    Characters outside the alphabet are skipped and what follows the padding is
    ignored. Wrong padding and bytes that are not UTF-8 give a NULL text and an
    error, so that one bad file does not end the job. Each step is a projection
    of its own, which keeps the scans of the text to one each.
    """
    over = F.length("_body") % 4
    padding = F.substring(F.col("_clean"), F.length("_body") + 1, F.lit(4) - over)
    padded = (over == 0) | ((over == 2) & (padding == "==")) | ((over == 3) & (padding == "="))
    return (
        # Line breaks are the usual strays and plain replacement is fast; the
        # regular expression is for texts that still hold others.
        df.withColumn("_joined", _without_breaks(F.col(content)))
        .withColumn(
            "_clean",
            F.when(F.col("_joined").rlike(_NO_STRAY), F.col("_joined")).otherwise(
                F.regexp_replace("_joined", _STRAY, "")
            ),
        )
        .withColumn("_body", F.substring_index("_clean", "=", 1))
        .withColumn("_padded", padded)
        # The decoder raises on a lone trailing letter, so it sees checked text only.
        .withColumn("_raw", F.unbase64(F.when(F.col("_padded"), F.col("_body"))).cast("string"))
        .withColumn(text, F.try_validate_utf8("_raw"))
        .withColumn(
            error,
            F.when(F.col("_clean").isNull(), "no content")
            .when(~F.col("_padded"), "incorrect base64 padding")
            .when(F.col(text).isNull(), "invalid utf-8"),
        )
        .drop("_joined", "_clean", "_body", "_padded", "_raw")
    )


def encode_blob(text: Column) -> Column:
    """Base64 on one line, whatever the session's setting for chunks."""
    return _without_breaks(F.base64(F.encode(text, "UTF-8")))


def _without_breaks(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
