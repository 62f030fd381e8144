from pyspark.sql import Window
from pyspark.sql import functions as F

from traceline.operators.ranking import number_files, number_rows


def test_numbers_equal_a_window_with_a_hot_group_and_copies(spark, rows):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") % 5).cast("double").alias("d"),
        F.col("id"),
    )
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.col("d").desc(), "id")))
    numbered = number_rows(df.repartition(6), ["g"], [F.col("d").desc(), "id"], "n")
    assert rows(numbered, "g", "d", "id", "n") == rows(expected)


def test_null_group_and_no_group(spark, rows):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "g string, o int")
    assert rows(number_rows(df, ["g"], ["o"], "n")) == [("a", 3, 1), (None, 1, 1), (None, 2, 2)]
    assert rows(number_rows(df, [], ["o"], "n", start=0), "o", "n") == [(1, 0), (2, 1), (3, 2)]


def test_file_numbers_are_dense_per_repository(spark, rows):
    df = spark.createDataFrame([("a", 9), ("a", 4), ("b", 7)], "repo_id string, pos long")
    assert rows(number_files(df)) == [("a", 4, 0), ("a", 9, 1), ("b", 7, 0)]
