"""What a plan must not do twice or in one task."""

import os

import pytest
from pyspark.sql import functions as F

from schemaloom.functions.text import nested_deeper
from schemaloom.operators import diff as D
from schemaloom.operators import extract as E
from schemaloom.operators import report as R
from schemaloom.plans import io_queries as IO
from schemaloom.sources import files as S
from schemaloom.sources import fixture as FX
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_changes_do_not_compare_twice(corpus_of):
    changes = D.version_changes(E.definitions(corpus_of([
        ("t", 1, "CREATE TABLE d.t (a INT)"), ("t", 2, "CREATE TABLE d.t (a INT, b INT)"),
        ("t", 3, "CREATE TABLE d.t (b INT, a INT)")])))
    once = plan(changes).count("zip_with(")
    assert once > 0
    for kept in (D.changed_versions(changes), R.change_report(changes)):
        assert plan(kept).count("zip_with(") <= once
        assert [r.v for r in kept.collect()] == [2]


@pytest.mark.parametrize("corpus", [FX.statement_corpus, FX.probe_corpus])
def test_statements_are_spread_for_extraction(spark, corpus):
    assert "RepartitionByExpression" in plan(corpus(spark, SF_SMALL))


def test_definition_files_have_no_job_commit(spark, corpus_of, tmp_path):
    """Written in place by tasks; written again, the same files."""
    corpus = corpus_of([("t", 1, "CREATE TABLE d.t (a INT)"), ("t", 2, "CREATE TABLE d.t (b INT)"),
                        ("a b:c", 1, "CREATE TABLE d.`a b:c` (ü INT)"), ("t", 3, None)])
    root = str(tmp_path / "tree")
    for _ in range(2):
        S.write_definition_files(corpus, root)
    names = sorted(os.path.relpath(os.path.join(at, f), root)
                   for at, _, fs in os.walk(root) for f in fs)
    assert [os.path.dirname(n) for n in names] == [
        "db=d/tbl=a b%3Ac/age=Last/v=1", "db=d/tbl=t/age=History/v=2", "db=d/tbl=t/age=Last/v=3"]
    files = S.DefinitionFiles(spark, root, str(tmp_path / "manifest"), glob="*.txt")
    got = {(r.tbl, r.v, r.is_history, r.ddl) for r in files.texts(files.pending()).collect()}
    scanned = {(r.tbl, r.v, r.is_history, r.ddl) for r in
               S.scan_definition_files(spark, root, glob="*.txt").collect()}
    assert got == scanned
    assert {x[1:] for x in got} == {(1, False, "CREATE TABLE d.`a b:c` (ü INT)"),
                                    (2, True, "CREATE TABLE d.t (b INT)"), (3, False, "")}


class _State:
    exists = False

    def update(self, value):
        self.get = value


def test_stream_makes_no_frame_without_pairs():
    import pandas as pd

    from schemaloom.streaming import drift_stream as ST
    state = _State()
    frame = pd.DataFrame({"v": [1, 3], "body": ["d1", None]})
    assert list(ST._pair_up(("d", "t"), iter([frame]), state)) == []
    state.exists = True
    out = list(ST._pair_up(("d", "t"), iter([pd.DataFrame({"v": [4, 2], "body": ["d4", "d2"]})]), state))
    assert [sorted(map(tuple, x.values.tolist())) for x in out] == [
        [("d", "t", 2, "d2", "d1"), ("d", "t", 4, "d4", "d2")]]


def test_line_items_are_shuffled_once(spark):
    """By order, as the join with the versions needs them, and not again behind it."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        rendered = FX.ddl_corpus(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    assert rendered.count("Exchange hashpartitioning(vid#") == 2  # line items, versions
    assert "RepartitionByExpression" not in plan(FX.corpus_table(spark, SF_SMALL))


def test_corpus_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(FX, "_CORPUS_TABLES", {})
    monkeypatch.setattr(FX, "TEXTS_AT_ONCE", 50)
    stored = FX.corpus_table(spark, SF_SMALL)
    assert stored.exceptAll(FX.ddl_corpus(spark, SF_SMALL)).isEmpty()
    counts = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert max(counts) == 50 and sum(counts) == FX.versions(spark, SF_SMALL).count()


def test_nesting_is_found_in_one_pass(spark):
    want = {" (a INT)": False, " (a DECIMAL(10,2), CHECK (b > 0))": False, " (a INT, CHECK ((b > 0)))": True,
            " (a INT, b ((INT": True, " (a INT": False, " ) a (b) (": False, "((a) (b) (c)": True,
            " (a A<B<C<D<E<INT>>>>>)": False, " (a A<B<C<D<E<F<INT>>>>>>)": True, "<<<<<<": True, "": False}
    rows = spark.createDataFrame([(t,) for t in want], "t string").withColumn("deep", nested_deeper(F.col("t")))
    assert {r.t: r.deep for r in rows.collect()} == want
    assert "regexp_replace" not in plan(rows)


def test_no_task_writes_a_quarter_of_the_table(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(IO, "scratch_path", lambda _, name: str(tmp_path / name))
    got = IO.compacted_by_size(spark, SF_SMALL).collect()
    rows = FX.table(spark, SF_SMALL, "lineitem").count()
    assert [tuple(r)[:4] for r in got] == [(2, True, True, rows)]
    for folder in ("in", "out/data"):
        files = spark.read.parquet(str(tmp_path / "packed" / folder)).groupBy(F.input_file_name()).count()
        assert max(r["count"] for r in files.collect()) <= rows / 10


def _base_tables(spark, folder):
    """Two tables of one database with three versions each, and two suppliers."""
    date = "timestamp_ntz'2020-01-01' + make_dt_interval(o) AS o_orderdate"
    rows = {
        "customer": "SELECT id AS c_custkey, 3 AS c_nationkey, 'X' AS c_mktsegment FROM range(1, 3)",
        "orders": f"SELECT id AS o_orderkey, id % 2 + 1 AS o_custkey, 'F' AS o_orderstatus, {date}, "
                  "'1-URGENT' AS o_orderpriority FROM (SELECT id, int(id) AS o FROM range(1, 7))",
        "lineitem": "SELECT id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, 1 AS l_quantity, "
                    "1.0 AS l_extendedprice, 0.0 AS l_discount, 0.0 AS l_tax, date'2020-01-01' AS l_shipdate, "
                    "'A' AS l_returnflag, 'O' AS l_linestatus FROM range(1, 7)",
        "supplier": "SELECT id AS s_suppkey, 3 AS s_nationkey, concat('S', id) AS s_name FROM range(1, 3)"}
    for name, query in rows.items():
        spark.sql(query).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_alerts_written_again_are_not_computed_again(spark, tmp_path, monkeypatch):
    read, write = [], IO.W.write_alerts

    def seen(alerts, path, run_id):
        read.append({f.split("/")[-2].rsplit("-", 1)[0] for f in alerts.inputFiles()})
        write(alerts, path, run_id)
    monkeypatch.setattr(IO.W, "write_alerts", seen)
    got = IO.alert_outbox(spark, _base_tables(spark, tmp_path)).collect()
    assert read == [{"told"}] * 2  # neither texts nor recipients
    assert sorted((r.db, r.tbl, r.v, r.recipient) for r in got) == [
        ("db_3", t, v, s) for t in ("t_1", "t_2") for v in (2, 3) for s in ("S1", "S2")]
