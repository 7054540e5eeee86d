"""Skew-safe numbering equals row_number() even with one huge group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from schemaloom.functions.sequence import number_within


def test_hot_key_numbering_matches_window(spark):
    # key 0 holds a third of all rows
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("k"),
        (F.col("id") * 7919 % 30_011).alias("o"), F.col("id"))
    got = number_within(df, ["k"], ["o", "id"], out="rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")))
    assert got.count() == 30_000
    assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0
