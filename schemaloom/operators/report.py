"""Reports and alerts.

Every text is assembled per version (bounded by the table's width) or per
table; no report gathers an unbounded group into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column_line
from .diff import KEYS
from .extract import SECTIONS

# Default wording
CHANGE_MARK = {"added": "+", "deleted": "-", "changed": "~"}
NEW_TABLE_TEXT = "new table "
DROPPED_TABLE_TEXT = "table dropped from the catalog: "
READABLE_TABLE_TEXT = "definition read for the first time: "
NONE_TEXT = "(none)"


def render_column_line(name: Column, type_: Column, comment: Column) -> Column:
    """A1: ``name TYPE[ COMMENT 'text']``."""
    return column_line(name, type_, comment)


def col_lines(cols: DataFrame) -> DataFrame:
    return cols.select(*KEYS, render_column_line(F.col("name"), F.col("type"),
                                                 F.col("comment")).alias("line"))


def section_no(section: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(SECTIONS, start=1))):
        out = F.when(section == s, F.lit(i)).otherwise(out)
    return out


def line_of(x: Column) -> Column:
    """The printable line of one change (section, change, old, new)."""
    old, new = (F.coalesce(x[c], F.lit(NONE_TEXT)) for c in ("old", "new"))
    mark = (F.when(x["change"] == "added", CHANGE_MARK["added"])
            .when(x["change"] == "deleted", CHANGE_MARK["deleted"])
            .otherwise(CHANGE_MARK["changed"]))
    what = (F.when(x["change"] == "added", new).when(x["change"] == "deleted", old)
            .otherwise(F.concat(old, F.lit(" -> "), new)))
    return F.concat(mark, F.lit(" "), x["section"], F.lit(": "), what)


def render_line(diff: DataFrame) -> DataFrame:
    """A2: one printable line per change."""
    x = {c: F.col(c) for c in ("section", "change", "old", "new")}
    return diff.select(*KEYS, section_no(F.col("section")).alias("section_no"), "name",
                       line_of(x).alias("line"))


def change_report(changes: DataFrame) -> DataFrame:
    """A3: db, tbl, v, body — lines ordered by section, then name. From
    ``version_changes`` (a projection) or the long form (grouped by version)."""
    if "changes" not in changes.columns:
        changes = changes.groupBy(*KEYS).agg(F.collect_list(F.struct(
            "section", "change", "name", "old", "new")).alias("changes"))
    rows = changes.where(F.size("changes") > 0).select(*KEYS, F.array_sort(F.transform(
        "changes", lambda x: F.struct(section_no(x["section"]).alias("no"),
                                      x["name"].alias("name"), line_of(x).alias("line")))).alias("ls"))
    return rows.select(*KEYS, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("body"))


def fan_out(reports: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A4: one row per report and recipient. Subscriptions (db, tbl,
    recipient) with tbl NULL cover the whole database, others one table: a
    report is looked up under both keys in one equi-join on (db, tbl, whole),
    so it is computed once. A recipient with both gets one row."""
    names = subscriptions.select("db", "tbl", "recipient").distinct()
    whole = names.where(F.col("tbl").isNull()).select("db", "recipient")
    own = names.where(F.col("tbl").isNotNull()).join(whole, ["db", "recipient"], "left_anti")
    keys = (whole.select("db", F.lit("").alias("_tbl"), F.lit(True).alias("_whole"), "recipient")
            .unionByName(own.select("db", F.col("tbl").alias("_tbl"), F.lit(False).alias("_whole"),
                                    "recipient")))
    asked = reports.select("*", F.inline(F.array(
        F.struct(F.lit("").alias("_tbl"), F.lit(True).alias("_whole")),
        F.struct(F.col("tbl").alias("_tbl"), F.lit(False).alias("_whole")))))
    return asked.join(keys, ["db", "_tbl", "_whole"]).select(*reports.columns, "recipient")


def new_table_alerts(new: DataFrame) -> DataFrame:
    """A5: db, tbl, body."""
    return new.select("db", "tbl", F.concat(F.lit(NEW_TABLE_TEXT), "db", F.lit("."), "tbl").alias("body"))


def readable_alerts(tables: DataFrame) -> DataFrame:
    """db, tbl, body of tables whose definition could be read for the first time."""
    return tables.select("db", "tbl", F.concat(
        F.lit(READABLE_TABLE_TEXT), "db", F.lit("."), "tbl").alias("body"))


def deleted_alerts(deleted: DataFrame) -> DataFrame:
    """Db, tbl, body — one row per table dropped from the catalog."""
    return deleted.select("db", "tbl", F.concat(
        F.lit(DROPPED_TABLE_TEXT), "db", F.lit("."), "tbl").alias("body"))


# SURVEY §2 signature names
render_section = render_line                # A2
new_table_alert = new_table_alerts          # A5
deleted_tables_alert = deleted_alerts       # A6
