"""Explicit schemas of the tables that cross a file boundary."""

from pyspark.sql import types as T

BLOB = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("encode", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

REPO_TREE = T.MapType(T.StringType(), BLOB)

# ``part`` numbers the pieces of a repository too large for one object; ``parts`` is how many there are.
PAYLOAD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("repository_tree", REPO_TREE),
        T.StructField("part", T.LongType()),
        T.StructField("parts", T.LongType()),
    ]
)

# Pairs are mixed-type JSON arrays, read as strings and cast afterwards.
SECTION_LISTS = T.StructType(
    [
        T.StructField("common_files", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("only_one_model", T.ArrayType(T.ArrayType(T.StringType()))),
        # Only in files of this package: place of the section, and files that come before in its lists.
        T.StructField("first_row", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)

RESULT_DOCUMENT = T.MapType(T.StringType(), SECTION_LISTS)

METRICS = T.StructType(
    [
        T.StructField("section_name", T.StringType()),
        T.StructField("TP", T.LongType()),
        T.StructField("FP", T.LongType()),
        T.StructField("TN", T.LongType()),
        T.StructField("FN", T.LongType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("specificity", T.DoubleType()),
        T.StructField("balanced_accuracy", T.DoubleType()),
    ]
)
