"""Skew-safe ``row_number() over (partition by keys order by …)``.

A plain window sends every row of one key to one task. If one table holds a
third of all versions, that task does a third of the job. Here the rows are
range-partitioned on (keys, order): the sampled range bounds split a hot key
over many partitions. Each partition numbers its own slice of a key. Only the
first key of a slice can have begun in an earlier one, so the offsets above
zero are at most one per partition and are broadcast. Every shuffle of rows is
on a key that spreads a hot group out.

Range bounds come from sampling, so two evaluations of the same plan may
slice differently. The sliced, locally numbered rows are therefore stored in
the shared scratch folder before both branches read them: slice ids are fixed
once, and a lost executor re-reads them instead of re-sampling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                  out: str = "rn", partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1, 2, … within each ``keys`` group in ``order``.

    ``order`` must be a total order inside a group (add a unique tie-break).
    Rows with a null key are left out.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    key_cols = [F.col(k) for k in keys]

    sliced = (df.dropna(subset=list(keys)).repartitionByRange(n, *key_cols, *order_cols)
              .withColumn("_slice", F.spark_partition_id()))
    w_local = Window.partitionBy("_slice", *keys).orderBy(*order_cols)
    path = scratch_path(spark, "numbered")
    numbered = sliced.withColumn("_lrn", F.row_number().over(w_local))
    numbered.write.parquet(path)
    local = spark.read.schema(numbered.schema).parquet(path)

    sizes = local.groupBy("_slice", *keys).agg(F.max("_lrn").alias("_cnt"))
    w_prior = (Window.partitionBy(*keys).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(
        "_slice", *keys, F.coalesce(F.sum("_cnt").over(w_prior), F.lit(0)).alias("_off")).where("_off > 0")

    return (local.join(F.broadcast(offsets), ["_slice", *keys], "left")
            .withColumn(out, (F.col("_lrn") + F.coalesce("_off", F.lit(0))).cast("int"))
            .drop("_slice", "_lrn", "_off"))
