"""K3/A4 delivery: the alerts of an outbox handed on once.

The outbox (``writers.write_alerts``) has one folder a run. ``pending`` gives
the alerts that no delivery has taken; ``deliver`` hands them to a sink and
then commits their ids to the ledger, an ``AppendLog``. A delivery repeated
under its id, or after it died before its commit, hands on nothing that the
ledger has. A sink that gets the same delivery id again replaces what it wrote
for that id (as the folder sink does), so every alert is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import AppendLog

LEDGER = "alert_id string, run_id string, attempt string"


def alert_id() -> F.Column:
    """An alert's identity: its run, recipient, table, version, kind and text."""
    return F.sha2(F.to_json(F.struct("run_id", "recipient", "db", "tbl", "v", "kind", "body"),
                            {"ignoreNullFields": "false"}), 256)


def read_outbox(spark: SparkSession, outbox: str) -> DataFrame:
    """alert_id, run_id, recipient, db, tbl, v, kind, body of all alerts."""
    rows = spark.read.parquet(outbox)
    for name, kind in (("v", "int"), ("kind", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("run_id", F.col("run_id").cast("string"))
    return rows.select(alert_id().alias("alert_id"), "run_id", "recipient", "db", "tbl", "v", "kind",
                       "body").dropDuplicates(["alert_id"])


def pending(spark: SparkSession, outbox: str, ledger: str) -> DataFrame:
    """Alerts that no committed delivery has handed on."""
    done = AppendLog(spark, ledger).read(LEDGER).select("alert_id")
    return read_outbox(spark, outbox).join(done, "alert_id", "left_anti")


def to_folder(path: str) -> Callable[[DataFrame, str], None]:
    """A sink that keeps each delivery in a folder of its own."""
    def sink(alerts: DataFrame, delivery: str) -> None:
        alerts.write.mode("overwrite").parquet(f"{path.rstrip('/')}/delivery={delivery}")
    return sink


def deliver(spark: SparkSession, outbox: str, ledger: str, delivery: str,
            sink: Callable[[DataFrame, str], None]) -> int:
    """Hand the pending alerts to ``sink`` and note them in the ledger. Returns
    how many; 0 for a delivery that was committed before."""
    def write(folder: str) -> None:
        pending(spark, outbox, ledger).write.parquet(folder)
        sink(spark.read.parquet(folder), delivery)  # what is noted is what is handed on
    log = AppendLog(spark, ledger)
    if not log.append(delivery, write):
        return 0
    return log.read(LEDGER, [delivery]).count()
