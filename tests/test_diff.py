"""Diff semantics and properties."""

from pyspark.sql import functions as F

from schemaloom.operators import diff as D
from schemaloom.operators import extract as E
from schemaloom.operators import history as H
from schemaloom.operators import report as R


def changes(spark, corpus_of, old, new):
    defs = E.definitions(corpus_of([("t", 1, old), ("t", 2, new)]))
    return defs, sorted((r.name, r.change) for r in D.diff_columns(defs).collect())


def test_column_order_is_ignored(spark, corpus_of):
    _, ch = changes(spark, corpus_of, "CREATE TABLE d.t (a INT, b INT)", "CREATE TABLE d.t (b INT, a INT)")
    assert ch == [("a", "same"), ("b", "same")]


def test_rename_is_delete_plus_add(spark, corpus_of):
    _, ch = changes(spark, corpus_of, "CREATE TABLE d.t (a INT)", "CREATE TABLE d.t (b INT)")
    assert ch == [("a", "deleted"), ("b", "added")]


def test_type_and_comment_changes(spark, corpus_of):
    defs, ch = changes(spark, corpus_of, "CREATE TABLE d.t (a INT, b INT COMMENT 'x')",
                       "create table d.t (a bigint, b int comment 'y')")
    assert ch == [("a", "changed"), ("b", "changed")]
    body = R.change_report(D.diff_definitions(defs)).first().body
    assert body.splitlines() == ["~ columns: a INT -> a BIGINT",
                                 "~ columns: b INT COMMENT 'x' -> b INT COMMENT 'y'"]


def test_spelling_is_not_drift(spark, corpus_of):
    defs = E.definitions(corpus_of([
        ("t", 1, "CREATE TABLE d.t (a DECIMAL(10, 2)) STORED AS ORC"),
        ("t", 2, "create  table `d`.`t`(`a` decimal(10,2))\n  stored   as orc")]))
    assert D.diff_definitions(defs).count() == 0
    fps = {r.fp for r in defs.select(H.fingerprint(defs).alias("fp")).collect()}
    assert len(fps) == 1


def test_attribute_and_constraint_sections(spark, corpus_of):
    defs = E.definitions(corpus_of([
        ("t", 1, "CREATE TABLE d.t (a INT, CONSTRAINT pk PRIMARY KEY (a)) STORED AS ORC"),
        ("t", 2, "CREATE EXTERNAL TABLE d.t (a INT) STORED AS PARQUET")]))
    got = sorted((r.section, r.change) for r in D.diff_definitions(defs).collect())
    assert got == [("constraints", "deleted"), ("kind", "added"), ("options_tail", "changed")]
    flags = D.change_flags(defs).first().asDict()
    assert flags["kind"] and flags["options_tail"] and flags["constraints"] and not flags["columns"]


def test_diff_properties_on_fixture(spark):
    from schemaloom.sources import fixture as FX
    defs = E.definitions(FX.ddl_corpus(spark, "/root/testdata/sf0.001")).cache()
    d = D.diff_columns(defs).cache()
    cols = E.def_columns(defs)
    # every new column is added/changed/same, every old one deleted/changed/same
    n_new = cols.filter("v > 1").count()
    assert d.filter(F.col("change").isin("added", "changed", "same")).count() == n_new
    later = cols.join(defs.select("db", "tbl", (F.col("v") - 1).alias("v")), ["db", "tbl", "v"], "left_semi")
    assert d.filter(F.col("change").isin("deleted", "changed", "same")).count() == later.count()
    # diff of a version with itself is empty
    same = defs.select("db", "tbl", "v", "vid", "captured_at", "columns", "part_columns",
                       "constraints", *E.ATTRIBUTES)
    twice = same.withColumn("v", F.col("v") * 2).unionByName(same.withColumn("v", F.col("v") * 2 + 1))
    pairs = D.diff_columns(twice).filter("v % 2 = 1")
    assert pairs.filter(F.col("change") != "same").count() == 0
