"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query starts from the test tables (the corpus is rendered from
customer / orders / lineitem) so its work grows with the scale factor.
Column names match ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_text, parse_stamp, version_stamp
from ..operators import diff as D
from ..operators import extract as E
from ..operators import history as H
from ..operators import report as R
from ..sources import fixture as FX

CUTOFF = "1998-01-01 00:00:00"
KEYS = ["db", "tbl", "v"]
DIFF_COLS = D.DIFF_COLUMNS


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return FX.corpus_table(spark, sf)


def defs(spark: SparkSession, sf: str) -> DataFrame:
    return E.definitions(corpus(spark, sf))


# ---- extraction -------------------------------------------------------------

def x_identity(spark, sf):
    return defs(spark, sf).select("v", "vid", F.col("ident_db").alias("db"),
                                  F.col("ident_tbl").alias("tbl"))


def _attr(name: str):
    def q(spark, sf):
        return E.filter_extracted(defs(spark, sf).select(*KEYS, name), F.col(name).isNotNull())
    q.__name__ = f"x_{name}"
    return q


def x_clustered(spark, sf):
    return E.filter_extracted(defs(spark, sf).select(*KEYS, "clustered", "cluster_cols", "n_buckets"),
                              F.col("clustered").isNotNull())


def x_skew(spark, sf):
    return E.filter_extracted(defs(spark, sf).select(*KEYS, "skewed", "skewed_on", "skewed_dirs"),
                              F.col("skewed").isNotNull())


def x_shape(spark, sf):
    return defs(spark, sf).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


def x_columns(spark, sf):
    return E.def_columns(defs(spark, sf)).select(*KEYS, "name", "type", "comment")


def x_part_columns(spark, sf):
    return E.def_part_columns(defs(spark, sf))


def x_constraints(spark, sf):
    return E.def_constraints(defs(spark, sf))


def x_definition(spark, sf):
    return defs(spark, sf).select(
        *KEYS, "shape", *E.ATTRIBUTES,
        F.size("columns").cast("bigint").alias("n_cols"),
        F.size("part_columns").cast("bigint").alias("n_part_cols"),
        F.size("constraints").cast("bigint").alias("n_constraints"))


def statements(spark, sf):
    return E.definitions(FX.statement_corpus(spark, sf))


def x_statements(spark, sf):
    d = statements(spark, sf)
    first = F.element_at("columns", 1)
    return d.select("tbl", "v", "shape", "provider", "table_comment", "options", "as_sql", "view_text",
                    F.when(F.size("columns") > 0, first["type"]).alias("first_type"),
                    F.when(F.size("columns") > 0, first["comment"]).alias("first_comment"),
                    F.col("reject_reason").isNotNull().alias("is_rejected"))


def x_rejected(spark, sf):
    return E.rejected(statements(spark, sf)).select("tbl", "v", "shape", "reject_reason")


def view_diff(spark, sf):
    return D.diff_views(statements(spark, sf)).select("tbl", "v", "old", "new")


def statement_diff(spark, sf):
    return D.diff_definitions(statements(spark, sf)).select("tbl", "v", "section", "change")


def x_probes(spark, sf):
    def lines(items):
        return F.array_join(F.array_sort(F.transform(items, lambda c: F.concat_ws(
            " ", c["name"], c["type"], c["comment"]))), "; ")
    return E.definitions(FX.probe_corpus(spark, sf)).select(
        "tbl", "v", "identity", lines("columns").alias("cols"), lines("part_columns").alias("parts"),
        F.array_join(F.array_sort("constraints"), "; ").alias("cons"), "clustered", "table_comment",
        "reject_reason")


def probe_diff(spark, sf):
    return D.diff_definitions(E.definitions(FX.probe_corpus(spark, sf))).select(
        "tbl", "v", "section", "change", "name", "old", "new")


# ---- diff -------------------------------------------------------------------

def version_pairs(spark, sf):
    return D.version_pairs(corpus(spark, sf))


def _col_diff(fn, change=None):
    def q(spark, sf):
        out = fn(defs(spark, sf))
        if change:
            out = out.filter(F.col("change") == change)
        return out.select(*DIFF_COLS)
    return q


def constraint_diff(spark, sf):
    return D.diff_constraints(defs(spark, sf))


def attr_diff(spark, sf):
    return D.diff_attributes(defs(spark, sf))


def def_diff(spark, sf):
    return D.diff_definitions(defs(spark, sf))


def gap_defs(spark, sf):
    return E.definitions(FX.gap_corpus(spark, sf))


def gap_pairs(spark, sf):
    return D.version_pairs(gap_defs(spark, sf))


def gap_diff(spark, sf):
    return D.diff_definitions(gap_defs(spark, sf))


def gap_report(spark, sf):
    return R.change_report(D.version_changes(gap_defs(spark, sf)))


def gap_versions(spark, sf):
    return H.version_intervals(gap_defs(spark, sf))


def change_flags(spark, sf):
    return D.change_flags(defs(spark, sf))


def changed_versions(spark, sf):
    return D.changed_versions(D.version_changes(defs(spark, sf)))


# ---- history ----------------------------------------------------------------

def _runs(spark, sf):
    d = corpus(spark, sf)
    cutoff = F.lit(CUTOFF).cast("timestamp_ntz")
    prev = d.filter(F.col("captured_at") < cutoff)
    cur = d.join(H.inventory(d.filter(F.col("captured_at") >= cutoff)), ["db", "tbl"], "left_semi")
    return prev, cur


def latest_def(spark, sf):
    return H.latest_definition(corpus(spark, sf))


def new_tables(spark, sf):
    prev, cur = _runs(spark, sf)
    return H.new_tables(prev, cur)


def deleted_tables(spark, sf):
    prev, cur = _runs(spark, sf)
    return H.deleted_tables(prev, cur)


def table_status(spark, sf):
    prev, cur = _runs(spark, sf)
    return H.classify_runs(corpus(spark, sf), prev.select(*KEYS), cur.select(*KEYS))


def last_seen(spark, sf):
    return H.last_seen(defs(spark, sf))


def distinct_versions(spark, sf):
    return H.distinct_versions(defs(spark, sf))


def version_intervals(spark, sf):
    return H.version_intervals(defs(spark, sf))


def archived_versions(spark, sf):
    return H.archived_versions(corpus(spark, sf))


def inventory(spark, sf):
    return H.inventory(corpus(spark, sf))


def inventory_filtered(spark, sf):
    return H.drop_database(H.inventory(corpus(spark, sf)), ["db_0"])


# ---- reports ----------------------------------------------------------------

def col_lines(spark, sf):
    return R.col_lines(E.def_columns(defs(spark, sf)))


def change_report(spark, sf):
    return R.change_report(D.version_changes(defs(spark, sf)))


def new_table_alerts(spark, sf):
    prev, cur = _runs(spark, sf)
    return R.new_table_alerts(H.new_tables(prev, cur))


def deleted_alert(spark, sf):
    prev, cur = _runs(spark, sf)
    return R.deleted_alerts(H.deleted_tables(prev, cur))


# ---- scalar functions -------------------------------------------------------

def fn_normalise(spark, sf):
    docs = FX.table(spark, sf, "documents")
    return docs.select("doc_id", normalise_text(F.col("text")).alias("norm_text"))


def fn_version_stamp(spark, sf):
    o = FX.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    stamp = version_stamp(F.col("o_orderdate"))
    return o.select("o_orderkey", stamp.alias("stamp"),
                    (parse_stamp(stamp) == F.col("o_orderdate")).alias("back_ok"))


# ---- whole run --------------------------------------------------------------

def drift_report(spark, sf):
    from .drift import drift_summary
    return drift_summary(D.version_changes(defs(spark, sf)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "inventory": inventory,
    "inventory_filtered": inventory_filtered,
    "archived_versions": archived_versions,
    "x_identity": x_identity,
    "x_kind": _attr("kind"),
    "x_like": _attr("like_table"),
    "x_clustered": x_clustered,
    "x_skew": x_skew,
    "x_tail": _attr("options_tail"),
    "x_shape": x_shape,
    "x_columns": x_columns,
    "x_part_columns": x_part_columns,
    "x_constraints": x_constraints,
    "x_definition": x_definition,
    "x_statements": x_statements,
    "x_rejected": x_rejected,
    "x_probes": x_probes,
    "probe_diff": probe_diff,
    "view_diff": view_diff,
    "statement_diff": statement_diff,
    "version_pairs": version_pairs,
    "col_diff": _col_diff(D.diff_columns),
    "cols_added": _col_diff(D.added_columns),
    "cols_deleted": _col_diff(D.deleted_columns),
    "cols_changed": _col_diff(D.changed_columns),
    "pcol_diff": _col_diff(D.diff_part_columns),
    "pcols_added": _col_diff(D.added_part_columns),
    "pcols_deleted": _col_diff(D.deleted_part_columns),
    "pcols_changed": _col_diff(D.changed_part_columns),
    "constraint_diff": constraint_diff,
    "attr_diff": attr_diff,
    "def_diff": def_diff,
    "gap_pairs": gap_pairs,
    "gap_diff": gap_diff,
    "gap_report": gap_report,
    "gap_versions": gap_versions,
    "change_flags": change_flags,
    "changed_versions": changed_versions,
    "latest_def": latest_def,
    "new_tables": new_tables,
    "deleted_tables": deleted_tables,
    "table_status": table_status,
    "last_seen": last_seen,
    "distinct_versions": distinct_versions,
    "version_intervals": version_intervals,
    "col_lines": col_lines,
    "change_report": change_report,
    "new_table_alerts": new_table_alerts,
    "deleted_alert": deleted_alert,
    "fn_normalise": fn_normalise,
    "fn_version_stamp": fn_version_stamp,
    "drift_report": drift_report,
}
