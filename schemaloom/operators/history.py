"""History and inventory state (H1-H8, K2).

"Last" and "history" of the saved-file store become queries over the
append-only corpus. Per-table results use aggregates with map-side partial
aggregation, or equi-joins on (db, tbl, v); whether a definition changed is
told from its fingerprint, and only versions that a question needs are
extracted.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diff import KEYS, VERSIONS_AT_ONCE, paired, readable
from .extract import ATTRIBUTES, definitions

TABLE = ["db", "tbl"]


def fingerprint(defs: DataFrame) -> Column:
    """sha-256 of the canonical definition: every section, columns sorted by
    name, constraints sorted. Never the raw text, so spelling does not count."""
    cols = F.array_sort(F.transform("columns", lambda c: F.struct(c["name"], c["type"], c["comment"])))
    pcols = F.array_sort(F.transform("part_columns",
                                     lambda c: F.struct(c["name"], c["type"], c["comment"])))
    body = F.struct(*[F.col(a) for a in ATTRIBUTES], cols.alias("columns"),
                    pcols.alias("part_columns"), F.array_sort("constraints").alias("constraints"))
    return F.sha2(F.to_json(body), 256)


def latest_definition(defs: DataFrame) -> DataFrame:
    """H1: db, tbl, v, vid of the newest version of every table."""
    return (defs.groupBy(*TABLE).agg(F.max(F.struct("v", "vid")).alias("m"))
            .select(*TABLE, "m.v", "m.vid"))


def latest_rows(defs: DataFrame) -> DataFrame:
    """Full definition rows of the newest version of every table."""
    return defs.join(latest_definition(defs).select(*KEYS), KEYS, "left_semi")


def archived_versions(defs: DataFrame) -> DataFrame:
    """K2: versions that have a successor (the "History" folder)."""
    succ = defs.select("db", "tbl", (F.col("v") - 1).alias("v"))
    return defs.select(*KEYS).join(succ, KEYS, "left_semi")


def inventory(df: DataFrame) -> DataFrame:
    """Distinct (db, tbl) of any relation."""
    return df.select(*TABLE).distinct()


def drop_database(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """H8: one exclusion list for every inventory step."""
    return df.filter(~F.col("db").isin(list(names)))


def new_tables(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """H2: tables in ``cur`` never seen in ``prev``."""
    return inventory(cur).join(inventory(prev), TABLE, "left_anti")


def deleted_tables(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """H3: tables of ``prev`` gone from ``cur``."""
    return inventory(prev).join(inventory(cur), TABLE, "left_anti")


def _status(prev: Column, cur: Column) -> Column:
    """Status of a table from its fingerprints; '' is an unreadable version."""
    return (F.when(prev.isNull(), "new").when(cur.isNull(), "deleted")
            .when(cur == "", "unreadable").when(prev != cur, "changed").otherwise("unchanged"))


def marked_fingerprint(defs: DataFrame) -> Column:
    """The fingerprint, or '' for a version that could not be read."""
    return F.when(readable(defs), fingerprint(defs)).otherwise(F.lit(""))


def classify_runs(corpus: DataFrame, prev_keys: DataFrame, cur_keys: DataFrame) -> DataFrame:
    """H4: db, tbl, status in new / deleted / changed / unchanged / unreadable.

    ``prev_keys`` / ``cur_keys`` (db, tbl, v) say which versions each run saw.
    Each run's newest version is found from keys alone; only these, two per
    table at most, are taken from the corpus and extracted."""
    def newest(keys: DataFrame, tag: str) -> DataFrame:
        return (keys.groupBy(*TABLE).agg(F.max("v").alias("v"))
                .withColumn("_run", F.lit(tag)))
    runs = newest(prev_keys, "prev").unionByName(newest(cur_keys, "cur"))
    needed = runs.groupBy(*KEYS).agg(F.collect_list("_run").alias("_runs"))
    defs = definitions(corpus.join(needed, KEYS))
    per_table = defs.select(*TABLE, marked_fingerprint(defs).alias("fp"), "_runs").groupBy(*TABLE).agg(
        F.max(F.when(F.array_contains("_runs", "prev"), F.col("fp"))).alias("fp_prev"),
        F.max(F.when(F.array_contains("_runs", "cur"), F.col("fp"))).alias("fp_cur"))
    return per_table.select(*TABLE, _status(F.col("fp_prev"), F.col("fp_cur")).alias("status"))


def classify_tables(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """H4 for two corpora: the newest version of each side."""
    both = prev.unionByName(cur).dropDuplicates(KEYS)
    return classify_runs(both, prev.select(*KEYS), cur.select(*KEYS))


def last_seen(defs: DataFrame, by: Iterable[str] = ("kind", "options_tail")) -> DataFrame:
    """H5: last capture date of each (table, definition attributes)."""
    by = list(by)
    return (defs.groupBy(*TABLE, *by)
            .agg(F.max(F.to_date("captured_at")).alias("last_seen")))


def distinct_versions(defs: DataFrame) -> DataFrame:
    """H6: first versions and versions whose fingerprint differs from the last
    readable one before; an unreadable one is left out. Two short fields per
    version are compared."""
    marked = defs.withColumn("_fp", fingerprint(defs))
    both = paired(marked, ["_fp", "vid", "captured_at"], firsts=True)
    changed = F.col("old").isNull() | (F.col("old._fp") != F.col("new._fp"))
    return both.where(changed).select(
        *KEYS, F.col("new.vid").alias("vid"), F.to_date("new.captured_at").alias("valid_from"))


def version_intervals(defs: DataFrame) -> DataFrame:
    """H7: valid_from / valid_to (next distinct version's date, NULL = current).

    Versions are numbered densely, so a table is cut into runs of
    VERSIONS_AT_ONCE numbers: a window inside a run, and one over the first
    rows of a table's runs, find the next version. No task holds a table, and
    nothing runs while the plan is built."""
    kept = (distinct_versions(defs).withColumn("_run", F.floor(F.col("v") / VERSIONS_AT_ONCE))
            .where(F.col("db").isNotNull() & F.col("tbl").isNotNull() & F.col("_run").isNotNull()))
    inside = Window.partitionBy(*TABLE, "_run").orderBy("v")
    rows = kept.withColumns({"valid_to": F.lead("valid_from").over(inside),
                             "_last": F.lead("v").over(inside).isNull(),
                             "_first": F.lag("v").over(inside).isNull()})
    over = Window.partitionBy(*TABLE).orderBy("_run")
    # vid goes along, and keys are not null above: all branches need the same
    # rows and columns, share one exchange, and the extraction runs once
    heads = rows.where("_first").select(
        *TABLE, "_run", F.lead(F.struct("valid_from", "vid")).over(over).alias("_next"))
    ends = rows.where("_last").drop("valid_to").join(heads, [*TABLE, "_run"])
    out = [*KEYS, "vid", "valid_from", "valid_to"]
    return (rows.where(~F.col("_last")).select(*out)
            .unionByName(ends.withColumn("valid_to", F.col("_next.valid_from")).select(*out)))


# SURVEY §2 signature names
archive_previous = archived_versions        # K2
touch_last_seen = last_seen                 # H5
collapse_unchanged = distinct_versions      # H6
