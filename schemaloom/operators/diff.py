"""Definition diff (D1-D16): each version against the last readable one before.

A version that could not be read is in no pair and never reported as a
change; the version after it is compared with the last one that was read,
however many lie between, so nothing that changed meanwhile is lost.

Predecessors are found by a carry-forward scan in two steps that keep no
table in one task: inside runs of VERSIONS_AT_ONCE version numbers by a window
over (db, tbl, run), and for the first readable version of a run from the last
readable one of the runs before, by a window over one row per run. All
branches share one exchange, so the texts are extracted once. The lists are
then compared inside the row with higher-order functions, without aggregation
of strings. Order of columns is ignored, a rename is a delete plus an add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import column_line
from .extract import ATTRIBUTES, SECTIONS, unnested

KEYS = ["db", "tbl", "v"]
DIFF_COLUMNS = ["db", "tbl", "v", "name", "change", "old_type", "new_type",
                "old_comment", "new_comment"]


def version_keys(defs: DataFrame) -> DataFrame:
    return defs.select(*KEYS)


VERSIONS_AT_ONCE = 1024


def version_pairs(defs: DataFrame) -> DataFrame:
    """Db, tbl, v, v_prev for every readable version that has a readable
    one before it. A corpus without ``reject_reason`` counts as readable."""
    return paired(defs, ["v"]).select(*KEYS, F.col("old.v").alias("v_prev"))


_ROW = ("struct<section:string,name:string,change:string,old_type:string,new_type:string,"
        "old_comment:string,new_comment:string>")
_ITEM = "struct<name:string,side:int,type:string,comment:string>"


def readable(defs: DataFrame) -> Column:
    """True where the whole text was read."""
    return F.col("reject_reason").isNull() if "reject_reason" in defs.columns else F.lit(True)


def paired(defs: DataFrame, fields, firsts: bool = False) -> DataFrame:
    """db, tbl, v, new, old: structs of ``fields`` of every readable version
    and of the last readable version before it; with ``firsts`` also versions
    without one (old is NULL). The extraction is read once."""
    table = KEYS[:2]
    # _ok comes out of a generator: a filter on it is not pushed below the
    # extraction, where it would run every regex a second time
    item = F.struct("v", F.col("_ok").alias("_ok"), F.col("_d").alias("_d"))
    rows = (defs.select(*KEYS, F.struct(*fields).alias("_d"), readable(defs).alias("_ok"))
            .select(*table, F.inline(F.array(item))).where("_ok").drop("_ok")
            .withColumn("_run", F.floor(F.col("v") / VERSIONS_AT_ONCE))
            # else the join below would add this to its branches alone
            .where(F.col("db").isNotNull() & F.col("tbl").isNotNull() & F.col("_run").isNotNull()))
    inside = Window.partitionBy(*table, "_run").orderBy("v")
    # plain columns in the windows: an expression would be computed below the exchange
    rows = rows.withColumns({"old": F.lag("_d").over(inside),
                             "_last": F.lead("v").over(inside).isNull()})
    over = Window.partitionBy(*table).orderBy("_run")
    ends = rows.where("_last").select(*table, "_run", F.lag("_d").over(over).alias("_before"))
    # no filter on _run here: it would be pushed below the exchange of this branch
    begun = rows.where(F.col("old").isNull()).join(ends, [*table, "_run"])
    if not firsts:
        begun = begun.where(F.col("_before").isNotNull())

    def pair(old: str) -> list[Column]:
        return [*map(F.col, KEYS), F.col("_d").alias("new"), F.col(old).alias("old")]
    return (rows.where(F.col("old").isNotNull()).select(*pair("old"))
            .unionByName(begun.select(*pair("_before"))))


def _entries(items: Column, side: int, listed: bool) -> Column:
    """name, side, type, comment of each item of a list section."""
    null = F.lit(None).cast("string")
    out = F.transform(items, lambda c: F.struct(
        (c["name"] if listed else c).alias("name"), F.lit(side).alias("side"),
        (c["type"] if listed else null).alias("type"),
        (c["comment"] if listed else null).alias("comment")))
    return F.coalesce(out, F.array().cast(f"array<{_ITEM}>"))


def _beside(both: str) -> Column:
    """Each entry of the sorted array with the one before and after it. The
    shifted copies are zipped, so no lambda refers to an outer array."""
    s, none = F.col(both), F.array(F.lit(None).cast(_ITEM))
    before = F.concat(none, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    after = F.concat(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), none)
    near = F.zip_with(before, after, lambda x, y: F.struct(x.alias("b"), y.alias("a")))
    return F.filter(F.zip_with(s, near, lambda c, z: F.struct(
        c.alias("c"), z["b"].alias("b"), z["a"].alias("a"))), lambda z: z["c"].isNotNull())


def _changes(section: str, beside: str) -> Column:
    """Rows of a list section: an old entry leads its new one (side 0 < 1)."""
    null = F.lit(None).cast("string")

    def row(z):
        c, a, old = z["c"], z["a"], z["c"]["side"] == 0
        both = old & a["name"].eqNullSafe(c["name"])
        same = c["type"].eqNullSafe(a["type"]) & c["comment"].eqNullSafe(a["comment"])
        return F.struct(
            F.lit(section).alias("section"), c["name"].alias("name"),
            F.when(~old, "added").when(~both, "deleted").when(same, "same").otherwise("changed")
            .alias("change"),
            F.when(old, c["type"]).otherwise(null).alias("old_type"),
            F.when(~old, c["type"]).when(both, a["type"]).otherwise(null).alias("new_type"),
            F.when(old, c["comment"]).otherwise(null).alias("old_comment"),
            F.when(~old, c["comment"]).when(both, a["comment"]).otherwise(null).alias("new_comment"))
    leads = F.filter(F.col(beside), lambda z: (z["c"]["side"] == 0)
                     | z["b"].isNull() | (z["b"]["name"] != z["c"]["name"]))
    return F.transform(leads, row)


def _attribute_rows(wanted) -> Column:
    null = F.lit(None).cast("string")
    rows = F.array(*[F.struct(
        F.lit(a).alias("section"), null.alias("name"),
        F.when(F.col(f"old.{a}").isNull(), "added").when(F.col(f"new.{a}").isNull(), "deleted")
        .otherwise("changed").alias("change"),
        F.col(f"old.{a}").alias("old_type"), F.col(f"new.{a}").alias("new_type"),
        null.alias("old_comment"), null.alias("new_comment")) for a in wanted])
    return F.filter(rows, lambda x: attribute_changed(x["old_type"], x["new_type"]))


def _with_rows(pairs: DataFrame, sections, keep_same: bool) -> DataFrame:
    """Adds ``rows``, the array of all difference rows of each pair."""
    lists = [s for s in ("columns", "part_columns", "constraints") if s in sections]
    wanted = [a for a in ATTRIBUTES if a in sections]
    d = pairs.withColumns({f"_s_{s}": F.sort_array(F.concat(
        _entries(F.col(f"old.{s}"), 0, s != "constraints"),
        _entries(F.col(f"new.{s}"), 1, s != "constraints"))) for s in lists})
    d = d.withColumns({f"_z_{s}": _beside(f"_s_{s}") for s in lists})
    parts = [_changes(s, f"_z_{s}") for s in lists]
    if not keep_same:
        parts = [F.filter(p, lambda x: x["change"] != "same") for p in parts]
    if wanted:
        parts.append(_attribute_rows(wanted))
    return d.withColumn("rows", parts[0] if len(parts) == 1 else F.concat(*parts))


def diff_long(defs: DataFrame, sections=tuple(SECTIONS), keep_same: bool = True) -> DataFrame:
    """Every section of every version against the previous version. List
    sections give every item (incl. "same" if ``keep_same``); attribute
    sections give only values that differ.
    -> db, tbl, v, section, name, change, old_type, new_type, old_comment, new_comment"""
    wanted = [s for s in SECTIONS if s in set(sections)]
    return unnested(_with_rows(paired(defs, wanted), wanted, keep_same), "rows", *KEYS)


def _list_diff(defs: DataFrame, section: str) -> DataFrame:
    return diff_long(defs, (section,)).select(*DIFF_COLUMNS)


def diff_columns(defs: DataFrame) -> DataFrame:
    """All columns of every version pair, change in added/deleted/changed/same."""
    return _list_diff(defs, "columns")


def added_columns(defs: DataFrame) -> DataFrame:   # D3
    return diff_columns(defs).filter(F.col("change") == "added")


def deleted_columns(defs: DataFrame) -> DataFrame:  # D2
    return diff_columns(defs).filter(F.col("change") == "deleted")


def changed_columns(defs: DataFrame) -> DataFrame:  # D4
    return diff_columns(defs).filter(F.col("change") == "changed")


def diff_part_columns(defs: DataFrame) -> DataFrame:
    """As D5 for partition columns (position is not compared)."""
    return _list_diff(defs, "part_columns")


def added_part_columns(defs: DataFrame) -> DataFrame:   # D7
    return diff_part_columns(defs).filter(F.col("change") == "added")


def deleted_part_columns(defs: DataFrame) -> DataFrame:  # D6
    return diff_part_columns(defs).filter(F.col("change") == "deleted")


def changed_part_columns(defs: DataFrame) -> DataFrame:  # D8
    return diff_part_columns(defs).filter(F.col("change") == "changed")


def diff_constraints(defs: DataFrame) -> DataFrame:
    """Db, tbl, v, text, change (added / deleted)."""
    return (diff_long(defs, ("constraints",), keep_same=False)
            .select(*KEYS, F.col("name").alias("text"), "change"))


def attribute_changed(old, new):
    """Null-aware inequality."""
    return ~old.eqNullSafe(new)


def diff_attributes(defs: DataFrame) -> DataFrame:
    """D11 (+D13 view text): db, tbl, v, section, old, new for each scalar
    section whose value differs from the previous version."""
    return (diff_long(defs, tuple(ATTRIBUTES), keep_same=False)
            .select(*KEYS, "section", F.col("old_type").alias("old"), F.col("new_type").alias("new")))


def _printed(x: Column) -> Column:
    """section, change, name, old, new of a difference row."""
    is_list = x["section"].isin("columns", "part_columns")
    is_attr = x["section"].isin(*ATTRIBUTES)

    def side(gone: str, type_: str, comment: str) -> Column:
        return (F.when(x["change"] == gone, F.lit(None))
                .when(is_list, column_line(x["name"], x[type_], x[comment]))
                .when(is_attr, x[type_]).otherwise(x["name"]))
    return F.struct(x["section"].alias("section"), x["change"].alias("change"),
                    x["name"].alias("name"), side("added", "old_type", "old_comment").alias("old"),
                    side("deleted", "new_type", "new_comment").alias("new"))


def changes_of(pairs: DataFrame) -> DataFrame:
    """db, tbl, v, changes of pairs from ``paired`` with all SECTIONS. The row
    comes out of a generator: a filter on ``changes`` is not pushed below the
    comparison, which would then run once more for the filter."""
    rows = _with_rows(pairs, SECTIONS, keep_same=False)
    return rows.select(F.inline(F.array(F.struct(
        *KEYS, F.transform("rows", _printed).alias("changes")))))


def version_changes(defs: DataFrame) -> DataFrame:
    """db, tbl, v, changes: one row per pair with the array of its real changes
    (section, change, name, old, new); empty if nothing changed. Reports, flags
    and summaries are projections of it, without another shuffle."""
    return changes_of(paired(defs, SECTIONS))


def diff_definitions(defs: DataFrame) -> DataFrame:
    """Every real change, long form:
    db, tbl, v, section, change, name, old, new."""
    return unnested(version_changes(defs), "changes", *KEYS)


def change_flags(defs: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row per readable pair, one boolean per section."""
    changes = changes if changes is not None else version_changes(defs)
    seen = changes.select(*KEYS, F.transform("changes", lambda x: x["section"]).alias("_s"))
    return seen.select(*KEYS, *[F.array_contains("_s", s).alias(s) for s in SECTIONS])


def changed_versions(diff: DataFrame) -> DataFrame:
    """Versions with any change, from ``diff_definitions`` (long form) or
    from ``version_changes`` (no shuffle)."""
    if "changes" in diff.columns:
        return diff.where(F.size("changes") > 0).select(*KEYS)
    return diff.select(*KEYS).distinct()


def diff_views(defs: DataFrame) -> DataFrame:
    """Changed view text."""
    return diff_attributes(defs).filter(F.col("section") == "view_text")


has_change = changed_versions               # D15
