"""Sinks (K1, K3, K5, K6): the append-only corpus, the alert outbox, file-count
control and recipient subscriptions. All are DataFrame writes; none goes
through the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import latest_definition
from .commits import AppendLog


def number_new_capture(captured: DataFrame, corpus: DataFrame | None) -> DataFrame:
    """Give a fresh capture (db, tbl, ddl, captured_at) its version numbers:
    v = last saved v + 1 per table (1 for new tables). One row per table on
    both sides of the join, so no key is hot."""
    if corpus is None:
        last = captured.select("db", "tbl").limit(0).withColumn("last_v", F.lit(0))
    else:
        last = latest_definition(corpus).select("db", "tbl", F.col("v").alias("last_v"))
    out = (captured.join(last, ["db", "tbl"], "left")
           .withColumn("v", (F.coalesce("last_v", F.lit(0)) + 1).cast("int"))
           .drop("last_v"))
    return out.withColumn("vid", F.xxhash64("db", "tbl", "v"))


def append_snapshot(corpus: DataFrame, path: str, run_id: str | None = None) -> bool:
    """K1: append versions to the corpus, partitioned by capture date (so a
    run's reads of recent versions prune old partitions). A run repeated under
    its id adds nothing and gives False; without an id every call is a run."""
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(folder: str) -> None:
        # Range-partition on (date, key) first: each task writes only the dates
        # of its range (files ~ tasks + dates, not tasks x dates), and a run whose
        # rows all share one capture date is still split over many tasks.
        (corpus.withColumn("capture_date", F.to_date("captured_at"))
         .repartitionByRange(n, "capture_date", "db", "tbl", "v")
         .write.partitionBy("capture_date").parquet(folder))
    return AppendLog(corpus.sparkSession, path).append(run_id or uuid.uuid4().hex, write)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Versions of all committed runs."""
    return AppendLog(spark, path).read().drop("run_id", "attempt")


def write_alerts(alerts: DataFrame, path: str, run_id: str) -> None:
    """K3: the alerts of a run in the outbox, under ``run_id=``; written again,
    they replace themselves. A notifier reads the outbox."""
    (alerts.withColumn("run_at", F.current_timestamp())
     .write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}"))


def write_compacted(df: DataFrame, path: str, n_files: int | None = None,
                    fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K5: control the number of output files. ``n_files`` spreads rows evenly
    over exactly that many tasks/files (never one task for the whole table
    unless asked); without it, AQE's rebalance picks file sizes."""
    out = df.repartition(n_files) if n_files else df.hint("rebalance")
    out.write.mode(mode).format(fmt).save(path)


FILES = "path string, size long, is_new boolean"


def compact_files(spark: SparkSession, path: str, out: str, target_bytes: int) -> DataFrame:
    """K5 by size: small Parquet files of the folder ``path`` packed into files of
    about ``target_bytes``; files of half of it or more are left as they are. A
    table with partition folders is packed folder by folder.

    Rows are not shuffled: Spark's own packing of files into read tasks, with
    ``target_bytes`` a task and no cost for opening, gives the bins, and a task
    writes one file below ``out``/data. The list of files that make up the
    table now (path, size, is_new) is written last, to ``out``/files, and
    returned; ``read_compacted`` goes by it. The small files may be deleted
    then. Repeated, it starts over.
    """
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .load(path)
             .select("path", F.col("length").alias("size")))
    small = [r.path for r in found.where(F.col("size") * 2 < target_bytes).toLocalIterator()]
    files = found.where(F.col("size") * 2 >= target_bytes).withColumn("is_new", F.lit(False))
    if small:
        wanted = {"spark.sql.files.maxPartitionBytes": str(target_bytes),
                  "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                spark.conf.set(k, v)
            spark.read.parquet(*small).write.mode("overwrite").parquet(f"{out}/data")
        finally:
            for k, v in before.items():
                if v is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, v)
        new = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{out}/data")
               .select("path", F.col("length").alias("size"), F.lit(True).alias("is_new")))
        files = files.unionByName(new)
    files.coalesce(1).write.mode("overwrite").json(f"{out}/files")
    return spark.read.schema(FILES).json(f"{out}/files")


def read_compacted(spark: SparkSession, out: str) -> DataFrame:
    """The table as ``compact_files`` left it."""
    return spark.read.parquet(*[r.path for r in spark.read.schema(FILES).json(f"{out}/files")
                                .toLocalIterator()])


def register_recipients(subscriptions: DataFrame, path: str) -> None:
    """K6: store subscriptions(db, tbl, recipient); tbl NULL = whole database."""
    subscriptions.select("db", "tbl", "recipient").write.mode("overwrite").parquet(path)


def read_recipients(spark: SparkSession, path: str) -> DataFrame:
    """The registered subscriptions (K6)."""
    return spark.read.schema("db string, tbl string, recipient string").parquet(path)


def subscriptions_from_suppliers(supplier: DataFrame) -> DataFrame:
    """Test subscriptions: per nation the first and last supplier name receive
    the alerts of database db_<nation>; every supplier also those of the table
    t_<its number> of its database."""
    own = supplier.select(
        F.concat(F.lit("db_"), F.col("s_nationkey").cast("string")).alias("db"),
        F.concat(F.lit("t_"), F.col("s_suppkey").cast("string")).alias("tbl"),
        F.col("s_name").alias("recipient"))
    per_nation = supplier.groupBy("s_nationkey").agg(
        F.min("s_name").alias("a"), F.max("s_name").alias("b"))
    return per_nation.select(
        F.concat(F.lit("db_"), F.col("s_nationkey").cast("string")).alias("db"),
        F.lit(None).cast("string").alias("tbl"),
        F.explode(F.array_distinct(F.array("a", "b"))).alias("recipient")).unionByName(own)


def write_single_file(df: DataFrame, path: str, n: int = 1, fmt: str = "parquet") -> None:
    """K5 as in the reference (file count as a parameter; 1 only when asked)."""
    write_compacted(df, path, n_files=n, fmt=fmt)
