"""Catalog and file sources, corpus sinks and the whole drift run."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.operators import extract as E
from schemaloom.plans.drift import DriftStore, run_drift_check, watch_catalog
from schemaloom.sinks.commits import AppendLog
from schemaloom.sinks import outbox as O
from schemaloom.sinks import writers as W
from schemaloom.sources import catalog as C
from schemaloom.sources import files as S


def test_catalog_inventory_and_capture(spark, tmp_path):
    db = f"cat_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db}")
    spark.sql(f"CREATE TABLE {db}.t1 (id BIGINT COMMENT 'key', dt STRING) USING parquet PARTITIONED BY (dt)")
    spark.sql(f"CREATE VIEW {db}.v1 AS SELECT id FROM {db}.t1")
    spark.range(3).createOrReplaceTempView("tmp_view_x")
    inv = C.scan_inventory(spark, exclude=["default"]).filter(F.col("db") == db)
    assert sorted((r.db, r.tbl) for r in inv.collect()) == [(db, "t1"), (db, "v1")]
    cap = C.capture_definitions(spark, inv, str(tmp_path / "cap"))
    corpus = cap.withColumn("v", F.lit(1)).withColumn("vid", F.lit(1).cast("bigint"))
    defs = {r.tbl: r for r in E.definitions(corpus).collect()}
    assert defs["v1"].shape == "view"
    t1 = defs["t1"]
    assert (t1.shape, t1.ident_db, t1.ident_tbl, t1.provider) == ("table", db, "t1", "parquet")
    assert [(c.name, c.type, c.comment) for c in t1.columns] == [
        ("dt", "STRING", None), ("id", "BIGINT", "key")]
    assert [c.name for c in t1.part_columns] == ["dt"]
    assert t1.reject_reason is None


def test_definition_files_reference_layout(spark, tmp_path):
    root = tmp_path / "store"
    for db, tbl, stamp, hist in [("d1", "a", "01_02_2020_10_00_00", False),
                                 ("d1", "a", "01_01_2020_09_00_00", True),
                                 ("d2", "b", "05_03_2021_00_00_01", False)]:
        folder = root / db / tbl / ("History" if hist else "")
        os.makedirs(folder, exist_ok=True)
        (folder / f"Last_{stamp}.hql").write_text(f"CREATE TABLE {db}.{tbl} (x INT)\n")
    (root / "d1" / "a" / "Sender_file.txt").write_text("someone")
    files = S.scan_definition_files(spark, str(root))
    assert files.count() == 3
    last = S.drop_history_paths(files).orderBy("db").collect()
    assert [(r.db, r.tbl, r.captured_at, r.ddl) for r in last] == [
        ("d1", "a", dt.datetime(2020, 2, 1, 10, 0, 0), "CREATE TABLE d1.a (x INT)"),
        ("d2", "b", dt.datetime(2021, 3, 5, 0, 0, 1), "CREATE TABLE d2.b (x INT)")]


def test_new_capture_numbering_and_snapshot(spark, corpus_of, tmp_path):
    saved = corpus_of([("t", 1, "CREATE TABLE d.t (a INT)"), ("t", 2, "CREATE TABLE d.t (a BIGINT)")])
    cap = spark.createDataFrame(
        [("d", "t", "CREATE TABLE d.t (a BIGINT, b INT)", dt.datetime(2021, 1, 1)),
         ("d", "u", "CREATE TABLE d.u (a INT)", dt.datetime(2021, 1, 1))],
        "db string, tbl string, ddl string, captured_at timestamp_ntz")
    fresh = W.number_new_capture(cap, saved)
    assert sorted((r.tbl, r.v) for r in fresh.collect()) == [("t", 3), ("u", 1)]
    path = str(tmp_path / "corpus")
    W.append_snapshot(saved, path)
    W.append_snapshot(fresh.select(*saved.columns), path)
    back = W.read_corpus(spark, path)
    assert back.count() == 4 and "capture_date" in back.columns


def capture(spark, *rows):
    return spark.createDataFrame([("d", t, ddl, dt.datetime(2021, 1, 1)) for t, ddl in rows],
                                 "db string, tbl string, ddl string, captured_at timestamp_ntz")


def listed(spark, *names):
    return spark.createDataFrame([("d", n) for n in names], "db string, tbl string")


def test_runs_keep_state(spark, tmp_path):
    """Transitions are told once, unchanged texts add no version, a table that
    comes back is new, a failed capture is no drop, a rerun changes nothing."""
    subs = spark.createDataFrame([("d", None, "ops"), ("d", "t", "owner-t"), ("d", "t", "ops"),
                                  ("x", None, "nobody")], "db string, tbl string, recipient string")
    store = DriftStore(spark, str(tmp_path / "store"))

    def run(n, names, *rows):
        return run_drift_check(spark, store, f"r{n}", f"r{n - 1}" if n > 1 else None,
                               listed(spark, *names), capture(spark, *rows), subs)

    def told(r):
        return sorted((x.kind, x.tbl, x.recipient) for x in r.alerts.collect())

    def status(r):
        return {x.tbl: x.status for x in r.status.collect()}
    t1, t2 = "CREATE TABLE d.t (a INT)", "CREATE TABLE d.t (a INT, b STRING COMMENT 'new')"
    g1, g2 = "CREATE TABLE d.gone (a INT)", "create table `d`.`gone` ( a int )"
    r = run(1, ["t", "gone"], ("t", t1), ("gone", g1))
    assert status(r) == {"t": "new", "gone": "new"}
    assert told(r) == [("new", "gone", "ops"), ("new", "t", "ops"), ("new", "t", "owner-t")]
    for _ in range(2):  # the second time is a rerun under the same id
        r = run(2, ["t"], ("t", t2))
        assert status(r) == {"t": "changed", "gone": "dropped"}
        assert told(r) == [("changed", "t", "ops"), ("changed", "t", "owner-t"),
                           ("dropped", "gone", "ops")]
        assert {x.body for x in r.alerts.collect() if x.kind == "changed"} == {
            "+ columns: b STRING COMMENT 'new'"}
    r = run(3, ["t"], ("t", t2))
    assert status(r) == {"t": "unchanged"} and told(r) == []
    r = run(4, ["t", "gone"], ("t", None), ("gone", g2))
    assert status(r) == {"t": "not_captured", "gone": "new"}
    assert [(x.tbl, x.reason) for x in r.rejected.collect()] == [("t", "capture failed")]
    r = run(5, ["t", "gone"], ("t", "CREATE TABLE d.t (a ((INT)"), ("gone", g1))
    assert status(r) == {"t": "unreadable", "gone": "unchanged"} and told(r) == []
    versions = spark.read.parquet(str(tmp_path / "store" / "corpus"))
    assert sorted((x.tbl, x.v) for x in versions.collect()) == [("gone", 1), ("t", 1), ("t", 2)]


def test_first_readable_text_is_told(spark, tmp_path):
    """A table whose first texts could not be read has an alert of its own."""
    subs = spark.createDataFrame([("d", None, "ops")], "db string, tbl string, recipient string")
    store = DriftStore(spark, str(tmp_path / "store"))
    got = []
    for n, text in enumerate(["CREATE TABLE d.t (a ((", None, "CREATE TABLE d.t (a INT)",
                              "CREATE TABLE d.t (a INT)"], 1):
        r = run_drift_check(spark, store, f"r{n}", f"r{n - 1}" if n > 1 else None,
                            listed(spark, "t"), capture(spark, ("t", text)), subs)
        got.append(([x.status for x in r.status.collect()], [x.body for x in r.alerts.collect()]))
    assert got[1:] == [(["not_captured"], []),
                       (["readable"], ["definition read for the first time: d.t"]), (["unchanged"], [])]
    assert [(x.n_runs, x.tbl) for x in r.seen.collect()] == [(2, "t")]


def test_a_run_writes_the_tables_that_changed(spark, tmp_path):
    """One table in a hundred changed: about that share of the state is
    written, the states of earlier runs stay, and buckets are merged in time."""
    subs = spark.createDataFrame([], "db string, tbl string, recipient string")
    store, n = DriftStore(spark, str(tmp_path / "store")), 600
    names = [f"t{i}" for i in range(n)]
    written = []
    for k in range(1, 4):
        rows = [(t, f"CREATE TABLE d.{t} (a INT, b{k if i % 100 == 7 else 0} INT)")
                for i, t in enumerate(names)]
        r = run_drift_check(spark, store, f"r{k}", f"r{k - 1}" if k > 1 else None,
                            listed(spark, *names), capture(spark, *rows), subs)
        written.append(r.n_written)
        state = store.latest(f"r{k}", T.StructType.fromDDL("db string, tbl string, v int, fp string"))
        assert state.count() == state.select("tbl").distinct().count() == n
    assert written[:2] == [n, 6] and written[2] < 30  # buckets of few tables are merged soon
    assert {x.status for x in r.status.collect()} == {"changed", "unchanged"}
    some = "db string, tbl string, v int, fp string"
    for k in range(4, 7):  # the same bucket grows until it is rewritten
        before = store.latest(f"r{k - 1}", T.StructType.fromDDL(some))
        added = before.where("tbl = 't7' or tbl = 't9'").withColumn("v", F.lit(k))
        store.add_latest(f"r{k}", f"r{k - 1}", before, added)
    assert max(len([p for p in store.parts("r6") if p[0] == b]) for b in range(16)) <= 12
    assert store.latest("r6", T.StructType.fromDDL(some)).where("tbl = 't7'").first().v == 6


def test_appends_happen_once(spark, corpus_of, tmp_path):
    saved = corpus_of([("t", 1, "CREATE TABLE d.t (a INT)"), ("t", 2, "CREATE TABLE d.t (a BIGINT)")])
    path = str(tmp_path / "corpus")
    assert W.append_snapshot(saved.where("v = 1"), path, "r1")
    assert not W.append_snapshot(saved.where("v = 1"), path, "r1")

    def dies(folder):
        saved.where("v = 2").write.parquet(folder)
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        AppendLog(spark, path).append("r2", dies)
    assert W.read_corpus(spark, path).count() == 1
    assert W.append_snapshot(saved.where("v = 2"), path, "r2")
    assert sorted(r.v for r in W.read_corpus(spark, path).collect()) == [1, 2]
    assert AppendLog(spark, str(tmp_path / "none")).read("a int").count() == 0


def test_watch_catalog(spark, tmp_path):
    """The live loop: listing, capture, comparison, corpus and outbox; a run
    repeated under its id adds nothing."""
    db = f"live_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db}")
    others = [r[0] for r in spark.sql("SHOW DATABASES").collect() if r[0] != db]
    subs = spark.createDataFrame([(db, None, "ops")], "db string, tbl string, recipient string")

    def run(k):
        r = watch_catalog(spark, str(tmp_path), f"r{k}", f"r{k - 1}" if k > 1 else None, subs, others)
        return {x.tbl: x.status for x in r.status.collect()}
    spark.sql(f"CREATE TABLE {db}.a (id INT) USING parquet")
    spark.sql(f"CREATE VIEW {db}.v AS SELECT id FROM {db}.a")
    assert run(1) == {"a": "new", "v": "new"}
    spark.sql(f"ALTER TABLE {db}.a ADD COLUMNS (x STRING)")
    spark.sql(f"DROP VIEW {db}.v")
    for _ in range(2):
        assert run(2) == {"a": "changed", "v": "dropped"}
    assert run(3) == {"a": "unchanged"}
    assert sorted((r.tbl, r.v) for r in W.read_corpus(spark, f"{tmp_path}/corpus").collect()) == [
        ("a", 1), ("a", 2), ("v", 1)]
    out = spark.read.parquet(f"{tmp_path}/outbox").collect()
    assert sorted((r.run_id, r.kind, r.tbl) for r in out) == [
        ("r1", "new", "a"), ("r1", "new", "v"), ("r2", "changed", "a"), ("r2", "dropped", "v")]


def test_files_are_read_when_new_or_changed(spark, tmp_path):
    folder = tmp_path / "tree" / "d1" / "a"
    os.makedirs(folder)
    files = S.DefinitionFiles(spark, str(tmp_path / "tree"), str(tmp_path / "manifest"))

    def scan(run, take=True):
        pending = files.pending()
        rows = sorted((r.path.rpartition("/")[2], r.ddl) for r in files.texts(pending).collect())
        if take:
            files.taken(pending, run)
        return rows
    (folder / "Last_01_01_2020_00_00_00.hql").write_text("CREATE TABLE d1.a (x INT)")
    first = [("Last_01_01_2020_00_00_00.hql", "CREATE TABLE d1.a (x INT)")]
    assert scan("s1", take=False) == first  # died before its commit
    assert scan("s1") == first and scan("s2") == []
    (folder / "Last_01_01_2020_00_00_00.hql").write_text("CREATE TABLE d1.a (x INT, y INT)")
    (folder / "Last_02_01_2020_00_00_00.hql").write_text("CREATE TABLE d1.a (z INT)")
    assert [t for _, t in scan("s3")] == ["CREATE TABLE d1.a (x INT, y INT)", "CREATE TABLE d1.a (z INT)"]
    assert scan("s4") == []


def test_alerts_are_delivered_once(spark, tmp_path):
    out, ledger, sent = (str(tmp_path / x) for x in ("out", "ledger", "sent"))

    def alerts(*bodies):
        return spark.createDataFrame([("ops", "d", "t", None, "changed", b) for b in bodies],
                                     "recipient string, db string, tbl string, v int, kind string, body string")
    W.write_alerts(alerts("a", "b", "b"), out, "r1")

    def dies(rows, delivery):
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        O.deliver(spark, out, ledger, "d1", dies)
    assert O.deliver(spark, out, ledger, "d1", O.to_folder(sent)) == 2
    assert O.deliver(spark, out, ledger, "d1", O.to_folder(sent)) == 0
    W.write_alerts(alerts("a", "b"), out, "r1")   # the run is repeated
    W.write_alerts(alerts("a"), out, "r2")        # the same text from another run
    assert O.deliver(spark, out, ledger, "d2", O.to_folder(sent)) == 1
    assert O.pending(spark, out, ledger).count() == 0
    assert sorted((r.run_id, r.body) for r in spark.read.parquet(sent).collect()) == [
        ("r1", "a"), ("r1", "b"), ("r2", "a")]


def test_small_files_are_packed(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(400_000).repartition(1).write.parquet(path)
    spark.range(400_000, 400_400).repartition(40).write.mode("append").parquet(path)
    large = max(os.path.getsize(f) for f in tmp_path.glob("in/*.parquet"))
    files = W.compact_files(spark, path, out, large).collect()
    assert [f.size for f in files if not f.is_new] == [large] and sum(f.is_new for f in files) == 1
    df = W.read_compacted(spark, out)
    assert df.count() == 400_400 == df.distinct().count()
    W.compact_files(spark, path, out, large)
    assert W.read_compacted(spark, out).count() == 400_400


def test_alerts_replace_themselves(spark, tmp_path):
    alerts = spark.createDataFrame([("d", "t", "x")], "db string, tbl string, body string")
    for run_id in ("a", "a", "b"):
        W.write_alerts(alerts, str(tmp_path / "out"), run_id)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def _odd_tree(root):
    for name in ("db=a/t1.hql", "db=a/b c/é%20.hql", "db=a/x/y/z.hql", "t#1.hql", ".hid/t.hql", "_h/t.hql",
                 "_k=1/t.hql", "_metadata/t.hql", "db=a/.t.hql", "db=a/_t.hql", "db=a/_t=1.hql", "a.hqlx",
                 "db=a/_metadata.hql", "db=a/t.hql._COPYING_", "b/none.hql", "T.HQL"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if "none" in name else name)
    (root / "empty").mkdir()
    os.symlink(root / "db=a" / "x", root / "linked")
    os.symlink(root / "gone", root / "broken.hql")


@pytest.mark.parametrize("at_once", [0, 2, 1000])
def test_tasks_list_what_spark_lists(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(S, "FOLDERS_AT_ONCE", at_once)
    root = tmp_path / "tree"
    _odd_tree(root)
    for top, glob in ((root, "*.hql"), (root, "{t?,[a-z]}.hql"), (f"{root}/db=*", "*"), (root / "t#1.hql", "*"),
                      (f"file:{root}/", "t1.hql"), (root / "empty", "*")):
        want = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                .option("pathGlobFilter", glob).load(str(top)).select("path", "length", "modificationTime"))
        got = S.list_files(spark, str(top), glob)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (top, glob)
    with pytest.raises(AnalysisException):
        S.list_files(spark, str(root / "gone"), "*")


def test_the_driver_holds_no_list_of_files(spark, tmp_path):
    """Neither of the tree nor of the manifest's paths: no file of the tree is an
    input of the plan, and the manifest, however small, is not broadcast."""
    _odd_tree(tmp_path / "tree")
    files = S.DefinitionFiles(spark, str(tmp_path / "tree"), str(tmp_path / "manifest"))
    files.taken(files.pending(), "one")
    (tmp_path / "tree" / "new.hql").write_text("new")
    pending = files.pending()
    assert [r.size for r in pending.collect()] == [3]
    assert not [p for p in pending.inputFiles() if "/tree/" in p]
    assert "Broadcast" not in pending._jdf.queryExecution().executedPlan().toString()
