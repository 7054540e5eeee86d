"""Registered queries that write and read back: definition files, corpus
snapshots, the alert outbox, table migration and the stream.

Scratch output goes below the shared scratch root (``spark.checkpoint.dir``
of the cluster); every call uses a fresh folder / database.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import extract as E
from ..operators import migrate as M
from ..operators import report as R
from ..session import scratch_path
from ..sinks import outbox as O
from ..sinks import writers as W
from ..sources import files as S
from ..sources import fixture as FX
from ..streaming import drift_stream as ST
from . import drift as DR

STREAM_DROPS = 10


def _file_rows(texts: DataFrame) -> DataFrame:
    return E.definitions(texts.select(
        "db", "tbl", "v", "is_history", F.lit(0).cast("bigint").alias("vid"), "captured_at", "ddl")).select(
        "db", "tbl", "v", "is_history", "kind", "options_tail",
        F.size("columns").cast("bigint").alias("n_cols"),
        F.size("part_columns").cast("bigint").alias("n_part_cols"))


def def_files(spark: SparkSession, sf: str) -> DataFrame:
    """Last and History files written, found by their paths, read and parsed:
    the definition of every file, the newest of a table and the one before."""
    root = scratch_path(spark, "def_files")
    S.write_definition_files(FX.corpus_table(spark, sf), root)
    found = S.scan_definition_files(spark, root, glob="*.txt")
    last = _file_rows(S.drop_history_paths(found))
    return last.unionByName(_file_rows(found.where("is_history")))


def def_files_again(spark: SparkSession, sf: str) -> DataFrame:
    """The tree of a third of the tables is scanned twice, then other tables'
    files come in: scan (1-3), and what it read."""
    root = scratch_path(spark, "def_files")
    files = S.DefinitionFiles(spark, f"{root}/tree", f"{root}/manifest", glob="*.txt")
    corpus = FX.corpus_table(spark, sf).where(F.col("vid") % 3 == 0)
    early = F.col("tbl").endswith("1")
    out = None
    for scan, rows in enumerate((early, None, F.col("tbl").endswith("2")), 1):
        if rows is not None:
            S.write_definition_files(corpus.where(rows), f"{root}/tree", history=0)
        pending = files.pending()
        read = _file_rows(files.texts(pending)).drop("is_history").withColumn("scan", F.lit(scan))
        files.taken(pending, f"scan{scan}")
        out = read if out is None else out.unionByName(read)
    return out


def append_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the corpus in one run, all versions after 1995 in another; an
    attempt that died before its commit and a repeated run add nothing."""
    path = scratch_path(spark, "corpus")
    late = F.col("captured_at") >= F.lit("1996-01-01").cast("timestamp_ntz")
    corpus = FX.corpus_table(spark, sf)
    (corpus.where(late).withColumn("capture_date", F.to_date("captured_at"))
     .repartitionByRange(8, "capture_date")
     .write.partitionBy("capture_date").parquet(f"{path}/data/run_id=late/attempt=died"))
    for run_id, rows in (("early", ~late), ("late", late), ("early", ~late)):
        W.append_snapshot(corpus.where(rows), path, run_id)
    return (W.read_corpus(spark, path).groupBy("capture_date")
            .agg(F.count(F.lit(1)).alias("n")))


def alert_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """Reports fanned out to registered recipients, read back from the outbox
    after it was written twice under one run id."""
    path = scratch_path(spark, "outbox")
    W.register_recipients(W.subscriptions_from_suppliers(FX.table(spark, sf, "supplier")),
                          f"{path}/recipients")
    defs = E.definitions(FX.corpus_table(spark, sf))
    alerts = R.fan_out(R.change_report(D.version_changes(defs)),
                       W.read_recipients(spark, f"{path}/recipients"))
    # stored: texts are read and compared once, however often alerts are written
    alerts.write.parquet(f"{path}/told")
    alerts = spark.read.schema(alerts.schema).parquet(f"{path}/told")
    for _ in range(2):
        W.write_alerts(alerts, f"{path}/alerts", run_id="r1")
    return (spark.read.parquet(f"{path}/alerts").select("db", "tbl", "v", "recipient", "body"))


def alerts_delivered(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of a run delivered by a delivery that dies behind the sink, again,
    and once more under its id; then those of a second run. Every alert is in
    the recipients' folders once."""
    path = scratch_path(spark, "outbox")
    subs = W.subscriptions_from_suppliers(FX.table(spark, sf, "supplier"))
    changes = D.version_changes(E.definitions(FX.corpus_table(spark, sf).where("v <= 4")))
    reports = R.change_report(changes)
    sink = O.to_folder(f"{path}/sent")

    def dies(alerts: DataFrame, delivery: str) -> None:
        sink(alerts, delivery)
        raise RuntimeError("lost")
    for run, v in (("r1", 2), ("r2", 3)):
        W.write_alerts(R.fan_out(reports.where(F.col("v") == v), subs), f"{path}/alerts", run_id=run)
        for deliver_to in (dies, sink, sink):
            try:
                O.deliver(spark, f"{path}/alerts", f"{path}/ledger", f"of_{run}", deliver_to)
            except RuntimeError:
                continue
    return spark.read.parquet(f"{path}/sent").select("db", "tbl", "v", "recipient", "body")


RUN_DATES = ["1994-01-01", "1996-01-01", "1997-06-01", "1998-07-01"]


def _runs(spark: SparkSession, sf: str):
    """Four runs over the catalog as it stood at RUN_DATES. Tables whose number
    ends in 3 are dropped at the second run, absent at the third and back at
    the fourth; those that end in 5 can't be read at the second, those in 8 at
    the first, and the capture of those in 6 fails at the third."""
    store = DR.DriftStore(spark, scratch_path(spark, "drift_store"))
    corpus = FX.corpus_table(spark, sf)
    subs = W.subscriptions_from_suppliers(FX.table(spark, sf, "supplier"))
    for i, date in enumerate(RUN_DATES, 1):
        seen = corpus.where(F.col("captured_at") < F.lit(date).cast("timestamp_ntz"))
        if i in (2, 3):
            seen = seen.where(~F.col("tbl").endswith("3"))
        newest = seen.groupBy("db", "tbl").agg(F.max("v").alias("v"))
        ends = {1: "8", 2: "5", 3: "6"}.get(i)
        text = F.col("ddl") if ends is None else F.when(
            ~F.col("tbl").endswith(ends), F.col("ddl")).when(F.lit(i < 3), F.lit("CREATE TABLE d.t (a (("))
        captured = seen.join(newest, ["db", "tbl", "v"]).select(
            "db", "tbl", text.alias("ddl"), "captured_at")
        yield i, DR.run_drift_check(spark, store, f"r{i}", f"r{i - 1}" if i > 1 else None,
                                    newest.select("db", "tbl"), captured, subs)


def drift_run(spark: SparkSession, sf: str) -> DataFrame:
    """run, db, tbl, status, the kind of its alert and the recipients told."""
    out = None
    for i, run in _runs(spark, sf):
        told = run.alerts.groupBy("db", "tbl", "kind").agg(F.count(F.lit(1)).alias("n"))
        rows = run.status.join(told, ["db", "tbl"], "left").select(
            F.lit(i).alias("run"), "db", "tbl", "status", F.coalesce("n", F.lit(0)).alias("n_told"),
            "kind")
        out = rows if out is None else out.unionByName(rows)
    return out


def drift_seen(spark: SparkSession, sf: str) -> DataFrame:
    """H5 over four runs: first and last capture of every whole definition."""
    *_, (_, last) = _runs(spark, sf)
    return last.seen.select("db", "tbl", F.to_date("first_seen").alias("first_seen"),
                            F.to_date("last_seen").alias("last_seen"), "n_runs")


# ---- migration --------------------------------------------------------------

PART_V2_COLUMNS = ("part_id BIGINT, part_name STRING, brand STRING, part_type STRING, "
                   "size BIGINT, price_cents BIGINT")


def part_select(source: str) -> str:
    return (f"SELECT p_partkey AS part_id, p_name AS part_name, upper(p_brand) AS brand, "
            f"p_type AS part_type, cast(p_size AS bigint) AS size, "
            f"cast(round(p_retailprice * 100) AS bigint) AS price_cents FROM {source}")


def scratch_database(spark: SparkSession, tag: str) -> str:
    name = f"sl_{tag}_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, name)}'")
    return name


def live_table(spark: SparkSession, sf: str, db: str, src: str) -> str:
    name = f"{db}.{src}"
    FX.table(spark, sf, src).write.format("parquet").saveAsTable(name)
    return name


def _backed_up(spark: SparkSession, sf: str) -> tuple[str, str]:
    db = scratch_database(spark, "bak")
    t = live_table(spark, sf, db, "lineitem")
    b = f"{t}__backup"
    M.create_backup(spark, t, b)
    M.backup_copy(spark, t, b)
    return t, b


def backup_copy(spark: SparkSession, sf: str) -> DataFrame:
    _, b = _backed_up(spark, sf)
    return spark.table(b).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def reconcile_counts(spark: SparkSession, sf: str) -> DataFrame:
    t, b = _backed_up(spark, sf)
    return M.reconcile_counts(spark.table(t), spark.table(b))


def reconcile_content(spark: SparkSession, sf: str) -> DataFrame:
    """A backup with planned faults: of the orders with key % 1000 = 1 the rows
    are missing, with 2 they are there twice, with 3 the quantity differs."""
    db = scratch_database(spark, "rec")
    t = live_table(spark, sf, db, "lineitem")
    kind = F.col("l_orderkey") % 1000
    times = F.when(kind == 1, 0).when(kind == 2, 2).otherwise(1)
    faulty = (spark.table(t).withColumn("_n", F.explode(F.array_repeat(F.lit(1), times))).drop("_n")
              .withColumn("l_quantity", F.when(kind == 3, F.col("l_quantity") + 1)
                          .otherwise(F.col("l_quantity"))))
    return M.reconcile_content(spark.table(t), faulty)


def compacted_write(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "compacted")
    W.write_compacted(FX.table(spark, sf, "lineitem"), path, n_files=4)
    back = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"))
    return back.agg(F.count_distinct("f").cast("bigint").alias("n_files"),
                    F.count(F.lit(1)).alias("n_rows"))


def compacted_by_size(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem in two large files and forty small ones, packed: the large ones
    stay, the small ones become few, within the target, and no row is lost. A
    large file, which one task writes, holds a twelfth of the rows."""
    path = scratch_path(spark, "packed")
    li = FX.table(spark, sf, "lineitem")
    large = F.col("l_orderkey") % 6 == 0
    li.where(large).repartition(2).write.parquet(f"{path}/in")
    li.where(~large).repartition(40).write.mode("append").parquet(f"{path}/in")
    sizes = [r.length for r in spark.read.format("binaryFile").load(f"{path}/in").select("length").collect()]
    target = max(sizes)
    files = W.compact_files(spark, f"{path}/in", f"{path}/out", target)
    told = files.agg(F.count(F.when(~F.col("is_new"), 1)).alias("n_untouched"),
                     F.coalesce(F.max(F.when(F.col("is_new"), F.col("size"))) <= 1.2 * target,
                                F.lit(False)).alias("within"),
                     (F.count(F.when(F.col("is_new"), 1)) < 25).alias("fewer"))
    rows = W.read_compacted(spark, f"{path}/out").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("l_orderkey")).alias("keys"))
    return told.crossJoin(rows)  # one row each


def reload_select(spark: SparkSession, sf: str) -> DataFrame:
    db = scratch_database(spark, "reload")
    live = live_table(spark, sf, db, "part")
    target = f"{db}.part_v2"
    spark.sql(f"CREATE TABLE {target} ({PART_V2_COLUMNS}) USING parquet")
    return M.reload_select(spark, part_select(live), target)


def _migrated(spark: SparkSession, sf: str) -> tuple[str, M.MigrationResult]:
    db = scratch_database(spark, "mig")
    live = live_table(spark, sf, db, "part")
    ddl = f"CREATE TABLE {live} ({PART_V2_COLUMNS}) USING parquet"
    res = M.migrate_table(spark, live, ddl, part_select(live), scratch_db=db)
    return live, res


def swap_in(spark: SparkSession, sf: str) -> DataFrame:
    live, res = _migrated(spark, sf)
    if res.status != "ok":
        raise RuntimeError(f"migration failed at {res.stage}: {res.error}")
    return spark.table(live)


def migration_summary(spark: SparkSession, sf: str) -> DataFrame:
    _, res = _migrated(spark, sf)
    return M.result_frame(spark, [res]).select("n_source", "n_backup", "n_new", "status")


class Killed(BaseException):
    """Ends a run at a stage like a lost driver: no handler of the run sees it."""


def migration_faults(spark: SparkSession, sf: str) -> DataFrame:
    """What goes wrong in a migration, and the live table after it: case, stage,
    status, rows and columns of the live table, working tables left."""
    db = scratch_database(spark, "flt")
    folder = scratch_path(spark, "flt_data")
    rows, second = [], []

    def live(name: str) -> str:
        t = f"{db}.{name}"
        (FX.table(spark, sf, "part").write.format("parquet")
         .option("path", f"{folder}/{name}/data").saveAsTable(t))
        return t

    def one(case: str, ddl: str, select: str, kill: str | None = None, late: str | None = None) -> None:
        t = live(case)
        where = {"same_location": f"{folder}/{case}/data", "parent_location": f"{folder}/{case}",
                 "child_location": f"{folder}/{case}/data/x"}.get(case)
        text = f"CREATE TABLE {t} ({ddl}) USING parquet" + (f" LOCATION '{where}'" if where else "")

        def on_stage(stage: str) -> None:
            if stage == kill:
                raise Killed(stage)
            if stage == late:  # rows come in, and somebody starts a second run
                spark.sql(f"INSERT INTO {t} SELECT * FROM {t} WHERE p_partkey % 10 = 0")
                second.append(M.migrate_table(spark, t, text, select.format(t=t), db))
        try:
            res = M.migrate_table(spark, t, text, select.format(t=t), db, on_stage=on_stage)
            stage, status = res.stage, res.status
        except Killed as k:
            stage, status = str(k), M.recover(spark, t, break_lease=True)
        left = sum(map(len, M.working_tables(spark, t).values()))
        rows.append((case, stage, status, spark.table(t).count(), len(spark.table(t).columns), left))

    fits, full = "id BIGINT, brand STRING", "SELECT p_partkey AS id, p_brand AS brand FROM {t}"
    for case in ("same_location", "parent_location", "child_location"):
        one(case, fits, full)
    one("bad_type", "id NOSUCHTYPE", full)
    one("extra_column", "id BIGINT", full)
    one("failing_select", fits, "SELECT p_partkey AS id, no_such_column AS brand FROM {t}")
    one("filtered", fits, full + " WHERE p_partkey % 2 = 0")
    one("aggregated", "brand STRING, n BIGINT",
        "SELECT p_brand AS brand, count(*) AS n FROM {t} GROUP BY p_brand")
    for stage in M.STAGES[1:-1]:
        one(f"killed_{stage}", fits, full, kill=stage)
    for stage in ("load", "verify", "swap"):
        one(f"late_{stage}", fits, full, late=stage)
    rows += [(f"second_run_{i}", s.stage, s.status, 0, 0, 0) for i, s in enumerate(second)]
    return spark.createDataFrame(rows, "case string, stage string, status string, n_live long, "
                                       "n_columns int, n_left int")


# ---- streaming --------------------------------------------------------------

def _streamed(spark: SparkSession, corpus: DataFrame) -> DataFrame:
    """Changes of capture records that arrive in STREAM_DROPS drops, in an order
    unrelated to version order, every seventh a second time in the next drop."""
    base = scratch_path(spark, "stream")
    src = f"{base}/in"
    drop = F.pmod(F.xxhash64("vid"), F.lit(STREAM_DROPS))
    again = F.when(F.col("vid") % 7 == 0, F.array(drop, (drop + 1) % STREAM_DROPS)).otherwise(F.array(drop))
    (corpus.withColumn("_drop", F.explode(again))
     .write.partitionBy("_drop").json(src))
    # as many batches as drops, however many files the tasks above wrote
    files = spark.read.schema(ST.CAPTURE_SCHEMA).json(src).inputFiles()
    per_drop = max(1, -(-len(files) // STREAM_DROPS))
    ST.stream_drift_check(spark, f"{src}/*", f"{base}/out", f"{base}/checkpoint",
                          max_files_per_trigger=per_drop)
    return ST.read_stream_result(spark, f"{base}/out")


def stream_drift(spark: SparkSession, sf: str) -> DataFrame:
    """The streamed changes equal the batch ``def_diff``."""
    return _streamed(spark, FX.corpus_table(spark, sf))


def gap_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Streamed with unreadable versions: equal to the batch ``gap_diff``."""
    return _streamed(spark, FX.gap_corpus(spark, sf))


IO_QUERIES = {
    "def_files": def_files,
    "def_files_again": def_files_again,
    "append_snapshot": append_snapshot,
    "alert_outbox": alert_outbox,
    "alerts_delivered": alerts_delivered,
    "drift_run": drift_run,
    "drift_seen": drift_seen,
    "backup_copy": backup_copy,
    "compacted_write": compacted_write,
    "compacted_by_size": compacted_by_size,
    "reconcile_counts": reconcile_counts,
    "reconcile_content": reconcile_content,
    "reload_select": reload_select,
    "swap_in": swap_in,
    "migration_summary": migration_summary,
    "migration_faults": migration_faults,
    "stream_drift": stream_drift,
    "gap_stream": gap_stream,
}
