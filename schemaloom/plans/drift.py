"""The drift run.

A run takes what the catalog holds now and compares it with the state that
the last run left in a store on shared storage:

    corpus/run_id=…      versions added by a run (unchanged texts add none)
    latest/part=…        newest definition of every table ever seen, extracted
    manifest/run_id=…    which parts of ``latest`` make up the state of a run
    seen/run_id=…        first and last capture of every definition
    inventory/run_id=…   tables in the catalog at the run
    rejected/run_id=…    captured texts that could not be read, failed captures
    alerts/run_id=…      alerts, one row per recipient

The newest definitions are hashed into BUCKETS. A run adds a part with the
tables that changed, and rewrites a bucket only when the parts above its base
have grown as large as the base (or are too many); the manifest, at most
BUCKETS x MOST_PARTS rows, names the parts of every bucket. So a run in which
one table in a hundred changed writes about a hundredth of the state, and the
state of the last run stays as it was: a run that is repeated under its id
gives the same store. A run reads the capture, that state and the last
inventory: it costs the catalog, not the history.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import diff as D
from ..operators import extract as E
from ..operators import history as H
from ..operators import report as R
from ..sinks import writers as W
from ..sources import catalog as C

TABLE = ["db", "tbl"]
LATEST = ["db", "tbl", "v", "fp", *E.SECTIONS]
ALERT_KINDS = ("changed", "new", "dropped", "readable")
MANIFEST = "bucket int, part string, n long, is_base boolean"
SEEN = "db string, tbl string, fp string, first_seen timestamp_ntz, last_seen timestamp_ntz, n_runs long"


def drift_summary(changes: DataFrame) -> DataFrame:
    """db, tbl, v, n_added, n_deleted, n_changed, n_attr per changed version, a
    projection of ``version_changes``."""
    def n(cond) -> F.Column:
        return F.size(F.filter("changes", cond)).cast("long")
    column = lambda x: x["section"] == "columns"
    return changes.where(F.size("changes") > 0).select(
        "db", "tbl", "v",
        n(lambda x: column(x) & (x["change"] == "added")).alias("n_added"),
        n(lambda x: column(x) & (x["change"] == "deleted")).alias("n_deleted"),
        n(lambda x: column(x) & (x["change"] == "changed")).alias("n_changed"),
        n(lambda x: ~column(x)).alias("n_attr"))


@dataclass
class DriftRun:
    """What a run wrote, read back from the store."""

    status: DataFrame     # db, tbl, status
    changes: DataFrame    # db, tbl, v, changes
    alerts: DataFrame     # kind, db, tbl, v, recipient, body
    rejected: DataFrame   # db, tbl, reason
    seen: DataFrame       # db, tbl, fp, first_seen, last_seen, n_runs
    n_written: int        # definitions written to the state


BUCKETS = 16
MOST_PARTS = 12  # parts of a bucket above which it is rewritten


class DriftStore:
    """Folders of the store; ``root`` is on shared storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame, name: str, run_id: str) -> DataFrame:
        path = f"{self.root}/{name}/run_id={run_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, run_id: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/run_id={run_id}")

    def parts(self, run_id: str) -> list[tuple[int, str, int, bool]]:
        """(bucket, part, rows, is the base) of a run's state; bounded."""
        return [tuple(r) for r in self.read("manifest", run_id, MANIFEST).collect()]

    def latest(self, run_id: str, schema) -> DataFrame:
        """The newest definition of every table after a run."""
        wanted: dict[str, list[int]] = {}
        for bucket, part, _, _ in self.parts(run_id):
            wanted.setdefault(part, []).append(bucket)
        if not wanted:
            return self.spark.createDataFrame([], schema)
        of = [(F.col("part") == p) & F.col("bucket").isin(b) for p, b in wanted.items()]
        rows = (self.spark.read.schema(T.StructType([
                    *schema.fields, T.StructField("part", T.StringType()),
                    T.StructField("bucket", T.IntegerType())]))
                .option("basePath", f"{self.root}/latest")
                .parquet(*[f"{self.root}/latest/part={p}" for p in wanted])
                .where(functools.reduce(lambda x, y: x | y, of)))  # prunes folders
        newest = rows.groupBy(*TABLE).agg(F.max("v").alias("v"))
        # a join, so that readers of a few columns read no others
        return rows.join(newest, [*TABLE, "v"], "left_semi").select(*schema.names)

    def add_latest(self, run_id: str, last_run: str | None, before: DataFrame,
                   added: DataFrame) -> int:
        """The state after a run: that of ``last_run`` with the definitions
        ``added``. Returns the rows written."""
        old = self.parts(last_run) if last_run is not None else []
        bucket = F.pmod(F.xxhash64(*TABLE), F.lit(BUCKETS)).cast("int")
        fresh = added.withColumn("bucket", bucket)
        n_new = {r.bucket: r["count"] for r in fresh.groupBy("bucket").count().collect()}
        whole = []
        for b, n in n_new.items():
            base = sum(k for x, _, k, is_base in old if x == b and is_base)
            above = [k for x, _, k, is_base in old if x == b and not is_base]
            if sum(above) + n > base or len(above) + 2 > MOST_PARTS:
                whole.append(b)
        kept = (before.withColumn("bucket", bucket).where(F.col("bucket").isin(whole))
                .join(added.select(*TABLE), TABLE, "left_anti"))
        path = f"{self.root}/latest/part={run_id}"
        (fresh.unionByName(kept).repartition("bucket").write.mode("overwrite")
         .partitionBy("bucket").parquet(path))
        n_now = {r.bucket: r["count"] for r in self.spark.read.schema(
            T.StructType([*added.schema.fields, T.StructField("bucket", T.IntegerType())]))
            .parquet(path).groupBy("bucket").count().collect()} if n_new else {}
        rows = [r for r in old if r[0] not in whole]
        rows += [(b, run_id, n_now[b], b in whole) for b in n_new]
        (self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/manifest/run_id={run_id}"))
        return sum(n_now.values())


_schemas: list[T.StructType] = []


def _latest_schema(spark: SparkSession) -> T.StructType:
    """Schema of LATEST, found once from an empty corpus."""
    if not _schemas:
        empty = spark.createDataFrame([], "db string, tbl string, v int, ddl string")
        _schemas.append(E.definitions(empty).withColumn("fp", F.lit("")).select(*LATEST).schema)
    return _schemas[0]


def run_drift_check(spark: SparkSession, store: DriftStore, run_id: str, last_run: str | None,
                    inventory: DataFrame, captured: DataFrame,
                    subscriptions: DataFrame) -> DriftRun:
    """One run. ``inventory`` (db, tbl) lists the catalog (S1); ``captured``
    (db, tbl, ddl, captured_at) has its texts (S2, null ddl: the capture
    failed); ``last_run`` is the id of the run before, None for the first.

    Status: new (in the catalog now, not at the last run; a table that is
    created again is new), dropped (reported once, at the transition),
    changed, unchanged (adds no version), unreadable, not_captured, readable
    (listed before, read for the first time now). Alerts of all kinds go to the
    recipients of the table and of its database. ``seen`` tells, by the
    fingerprint of the whole definition, when each was captured first and last
    and in how many runs (unchanged tables are stamped again).
    """
    latest_schema = _latest_schema(spark)
    inventory_schema = inventory.select(*TABLE).schema
    if last_run is None:
        before = spark.createDataFrame([], latest_schema)
        listed = spark.createDataFrame([], inventory_schema)
        known = spark.createDataFrame([], SEEN)
    else:
        before = store.latest(last_run, latest_schema)
        known = store.read("seen", last_run, SEEN)
        listed = store.read("inventory", last_run, inventory_schema)
    now = store.write(inventory.select(*TABLE).distinct(), "inventory", run_id)

    # the capture is extracted once; a second row of a table is dropped
    texts = (captured.where(F.col("ddl").isNotNull()).dropDuplicates(TABLE)
             .join(now, TABLE, "left_semi")
             .join(before.select(*TABLE, F.col("v").alias("_last")), TABLE, "left")
             .select(*TABLE, (F.coalesce("_last", F.lit(0)) + 1).cast("int").alias("v"),
                     "captured_at", "ddl"))
    defs = E.definitions(texts.withColumn("_ddl", F.col("ddl")))
    fresh = store.write(defs.withColumn("fp", H.marked_fingerprint(defs)).select(
        *LATEST, "captured_at", "reject_reason", F.col("_ddl").alias("ddl")), "captured", run_id)

    old = before.select(*TABLE, F.col("fp").alias("_fp"))
    was, is_ = listed.withColumn("_was", F.lit(True)), now.withColumn("_is", F.lit(True))
    state = (was.join(is_, TABLE, "full_outer")
             .join(fresh.select(*TABLE, "fp"), TABLE, "left").join(old, TABLE, "left")
             .select(*TABLE, F.when(F.col("_is").isNull(), "dropped")
                     .when(F.col("_was").isNull(), "new")
                     .when(F.col("fp").isNull(), "not_captured").when(F.col("fp") == "", "unreadable")
                     .when(F.col("_fp").isNull(), "readable")
                     .when(F.col("_fp") != F.col("fp"), "changed")
                     .otherwise("unchanged").alias("status")))
    status = store.write(state, "status", run_id)

    read = fresh.where(F.col("fp") != "")
    added = read.join(before.select(*TABLE, "fp"), [*TABLE, "fp"], "left_anti")
    store.write(added.select(*TABLE, "v", F.xxhash64(*TABLE, "v").alias("vid"), "captured_at", "ddl"),
                "corpus", run_id)
    n_written = store.add_latest(run_id, last_run, before, added.select(*LATEST))
    one = F.lit(1).cast("long")
    seen = store.write(known.unionByName(read.select(
        *TABLE, "fp", F.col("captured_at").alias("first_seen"), F.col("captured_at").alias("last_seen"),
        one.alias("n_runs"))).groupBy(*TABLE, "fp").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("n_runs").alias("n_runs")), "seen", run_id)
    failed = captured.where(F.col("ddl").isNull()).select(*TABLE, F.lit("capture failed")
                                                          .alias("reason"))
    rejected = store.write(fresh.where(F.col("fp") == "").select(
        *TABLE, F.col("reject_reason").alias("reason")).unionByName(failed.distinct()),
        "rejected", run_id)

    # each changed table against its last definition: pairs of (v - 1, v)
    moved = status.where(F.col("status") == "changed").select(*TABLE)
    pairs = (added.join(moved, TABLE, "left_semi").select(*TABLE, "v", *E.SECTIONS)
             .unionByName(before.join(moved, TABLE, "left_semi").select(*TABLE, "v", *E.SECTIONS)))
    changes = store.write(D.version_changes(pairs), "changes", run_id)
    of = lambda s: status.where(F.col("status") == s).select(*TABLE)
    bodies = (
        R.change_report(changes).withColumn("kind", F.lit("changed"))
        .unionByName(R.new_table_alerts(of("new")).withColumn("kind", F.lit("new")), True)
        .unionByName(R.readable_alerts(of("readable")).withColumn("kind", F.lit("readable")), True)
        .unionByName(R.deleted_alerts(of("dropped")).withColumn("kind", F.lit("dropped")), True))
    alerts = store.write(R.fan_out(bodies.select("kind", "db", "tbl", "v", "body"), subscriptions),
                         "alerts", run_id)
    return DriftRun(status=status, changes=changes, alerts=alerts, rejected=rejected, seen=seen,
                    n_written=n_written)


def watch_catalog(spark: SparkSession, root: str, run_id: str, last_run: str | None,
                  subscriptions: DataFrame, exclude: Iterable[str] = ()) -> DriftRun:
    """The whole live run over the session's catalog: list its tables (S1),
    capture their texts (S2), compare with the state of ``last_run`` (P1),
    append the new versions to the corpus (K1) and the alerts to the outbox
    (K3), all below ``root`` on shared storage. Repeated under its id, a run
    uses the texts that it captured first and adds nothing twice."""
    store = DriftStore(spark, f"{root.rstrip('/')}/store")
    inventory = store.write(C.scan_inventory(spark, exclude), "listing", run_id)
    captured = C.capture_definitions(spark, inventory, f"{store.root}/captures", run_id)
    run = run_drift_check(spark, store, run_id, last_run, inventory, captured, subscriptions)
    added = spark.read.parquet(f"{store.root}/corpus/run_id={run_id}")
    W.append_snapshot(added, f"{root.rstrip('/')}/corpus", run_id)
    W.write_alerts(run.alerts, f"{root.rstrip('/')}/outbox", run_id)
    return run
