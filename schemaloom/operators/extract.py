"""Extraction over a DDL corpus.

``definitions(corpus)`` turns each CREATE TABLE / VIEW text into one row of
attributes plus arrays of columns, partition columns and constraints. It is a
single chain of projections built from regexp / higher-order functions —
no Python UDF, no shuffle. Texts that cannot be read completely keep their
row and get a ``reject_reason`` instead of silently losing parts.

Exploded views: ``def_columns``, ``def_part_columns``, ``def_constraints``,
``def_attrs``, ``rejected``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import (SEP, blank_null, groups, has_quote, mask_nested, name_parts, nested_deeper,
                              norm_clause, norm_ident, norm_type, once, rx_all, unmask, unquote,
                              without_comments)

# scalar sections, in report order
ATTRIBUTES = ["kind", "identity", "clustered", "skewed", "skewed_on", "skewed_dirs",
              "as_sql", "options_tail", "like_table", "view_text", "provider",
              "table_comment", "options"]
# every diff section, in report order
SECTIONS = ["columns", "part_columns", *ATTRIBUTES[:9], "constraints", *ATTRIBUTES[9:]]


def _is_constraint(item: Column) -> Column:
    return item.rlike(P.CONSTRAINT_ITEM)


_COL_TEMPLATE = SEP.join(["$1", "$2", "$3"])


def _item_parts(items: str) -> Column:
    """Per non-constraint item, ONE regex pass: [name, type, comment] when the
    item is ``name type …``, else [item] (a bare name or junk)."""
    return F.transform(F.filter(items, lambda x: ~_is_constraint(x)),
                       lambda x: F.split(F.regexp_replace(x, P.COLUMN_ITEM, _COL_TEMPLATE), SEP, 3))


def _parts_to_columns(parts: str) -> Column:
    """[name, type, comment] arrays -> STRUCT(name, pos, type, comment)."""
    def one(p, i):
        typed = F.size(p) == 3
        return F.struct(
            norm_ident(F.when(typed, p[0]).otherwise(F.regexp_extract(p[0], P.BARE_ITEM, 1))).alias("name"),
            (i + 1).cast("int").alias("pos"),
            F.when(typed, norm_type(p[1])).alias("type"),
            F.when(typed & (p[2] != ""), unquote(p[2])).alias("comment"),
        )
    return F.transform(parts, one)


_COL_TYPE = "struct<name:string,pos:int,type:string,comment:string>"


def _first_per_name(sorted_col: str) -> Column:
    """Keep the first item (lowest pos) of each name from an array already
    sorted by (name, pos); result stays sorted by name.

    Each element is compared with its predecessor by zipping the array with
    a copy shifted by one. No lambda refers to the outer array: Catalyst may
    inline the producer of a column into a lambda, which would then re-run
    (sort, regexes) once per element."""
    s = F.col(sorted_col)
    prev = F.concat(F.array(F.lit(None).cast(_COL_TYPE)),
                    F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    pairs = F.zip_with(s, prev, lambda c, p: F.struct(c.alias("c"), p.alias("p")))
    # zip_with pads the shorter side with NULL: an empty list must stay empty
    firsts = F.filter(pairs, lambda z: z["c"].isNotNull()
                      & (z["p"].isNull() | (z["p"]["name"] != z["c"]["name"])))
    return F.transform(firsts, lambda z: z["c"])


def definitions(corpus: DataFrame) -> DataFrame:
    """corpus(db, tbl, v, vid, captured_at, ddl, …) -> one definition row each.

    A handful of projection stages; each regex runs once per text (several
    groups come from one pass), and nothing leaves the partition."""
    ddl = F.col("_sql")
    c = F.col
    d = corpus.withColumn("_sql", without_comments(c("ddl"))).withColumns({
        "_view": F.regexp_extract(ddl, P.VIEW_HEAD, 1),
        "_h": groups(ddl, P.TABLE_HEAD, 3),   # kind, name, text after the name
    })
    d = d.withColumn("_deep", F.coalesce(nested_deeper(c("_h")[2]), F.lit(False)))
    d = d.withColumns({
        "_kind": c("_h")[0], "_name": blank_null(c("_h")[1]),
        "_after": F.when(c("_deep"), F.coalesce(mask_nested(c("_h")[2]), c("_h")[2]))
        .otherwise(c("_h")[2]),
        "_like": F.when(c("_view") == "", F.regexp_extract(c("_h")[2], P.LIKE_AFTER, 1)),
    })
    d = d.withColumn(
        "shape",
        F.when(c("_view") != "", "view")
        .when(c("_name").isNull(), F.lit(None).cast("string"))
        .when(c("_like") != "", "like")
        .otherwise("table"))
    is_table = c("shape") == "table"
    d = d.withColumns({
        "_body_full": F.when(is_table, F.regexp_extract("_after", P.BODY_AFTER, 0)),
        "_opens": is_table & c("_after").rlike(P.OPENS_PAREN),
    })
    d = d.withColumns({
        "_body": F.when(c("_body_full") != "",
                        F.regexp_extract("_body_full", P.INSIDE_PARENS, 1)),
        "_rest": F.when(c("shape").isin("table", "like"), c("_after").substr(
            F.coalesce(F.length("_body_full"), F.lit(0)) + 1, F.length("_after") + 1)),
    })
    # Clause scans run only where their keyword occurs at all (a cheap
    # substring test on the lower-cased remainder); the regex decides.
    d = d.withColumn("_rl", F.lower(F.coalesce(c("_rest"), F.lit(""))))
    has = lambda word: c("_rl").contains(word)
    # column list -> items; clauses after it, one scan each
    d = d.withColumns({
        "_items": rx_all(F.coalesce(c("_body"), F.lit("")), P.ITEM),
        "_pfull": F.when(has("partitioned"), F.regexp_extract(
            F.coalesce(c("_rest"), F.lit("")), P.PARTITIONED, 1)).otherwise(F.lit("")),
        "_cl": F.when(has("cluster"), groups(c("_rest"), P.CLUSTERED, 3)),
        "_sk": F.when(has("skewed"), groups(c("_rest"), P.SKEWED, 3)),
        "_ct": F.when(c("_rl").rlike(P.CTAS_START), groups(c("_rest"), P.CTAS_SPLIT, 2)),
    })
    d = d.withColumns({
        "_pword": has("partitioned") & (c("_pfull") == "")
        & F.coalesce(c("_rest"), F.lit("")).rlike(P.PARTITIONED_WORD),
        "_items_ok": c("_body").isNull() | (F.array_join("_items", ",") == c("_body")),
        "_cons": F.filter("_items", _is_constraint),
        "_colparts": _item_parts("_items"),
        "_pitems": rx_all(F.regexp_extract("_pfull", P.INSIDE_PARENS, 1), P.ITEM),
        "_pre": F.coalesce(c("_ct")[0], c("_rest")),
    })
    d = d.withColumns({"_pparts": _item_parts("_pitems")})
    d = d.withColumns({"_cols": _parts_to_columns("_colparts"),
                       "_pcols": _parts_to_columns("_pparts")})
    d = d.withColumns({
        "constraints": F.array_distinct(F.transform("_cons", norm_clause)),
        "_cols_sorted": F.sort_array("_cols"),
        "_bad_item": F.exists(F.concat("_cols", "_pcols"), lambda x: x["name"].isNull()
                              | (x["type"].isNotNull() & has_quote(x["type"])
                                 & ~x["type"].rlike(P.TYPE_TEXT)))
        | F.exists("_cols", lambda x: x["type"].isNull() & x["name"].rlike(rf"[({P.MASK[0]}]")),
        "_pcols_sorted": F.sort_array("_pcols"),
        "_tail": groups(c("_pre"), P.TAIL, 1)[0],
        "provider": F.when(has("using"), F.lower(blank_null(F.regexp_extract("_pre", P.PROVIDER, 1)))),
        "options": F.when(has("options"), norm_clause(F.regexp_extract("_pre", P.OPTIONS, 1))),
        "table_comment": F.when(has("comment"), once(
            F.regexp_extract("_pre", P.TABLE_COMMENT, 1), lambda x: F.when(x != "", unquote(x)))),
        "_parts": name_parts(F.when(c("_view") != "", c("_view")).otherwise(c("_name"))),
    })
    d = d.withColumns({
        "columns": _first_per_name("_cols_sorted"),
        "part_columns": _first_per_name("_pcols_sorted"),
        "clustered": norm_clause(c("_cl")[0]),
        "cluster_cols": norm_clause(F.regexp_extract(c("_cl")[1], P.INSIDE_PARENS, 1)),
        "n_buckets": blank_null(c("_cl")[2]).try_cast("int"),
        "skewed": norm_clause(c("_sk")[0]),
        "skewed_on": norm_clause(c("_sk")[1]),
        "skewed_dirs": norm_clause(c("_sk")[2]),
        "as_sql": norm_clause(c("_ct")[1]),
        "options_tail": norm_clause(c("_tail")),
        "ident_tbl": F.try_element_at("_parts", F.lit(-1)),
        "ident_db": F.when(F.size("_parts") >= 2, F.try_element_at("_parts", F.lit(-2))),
        "kind": blank_null(F.lower(F.regexp_replace("_kind", r"\s+", " "))),
        "like_table": blank_null(F.array_join(name_parts(c("_like")), ".")),
        "view_text": F.when(c("shape") == "view", norm_clause(ddl)),
        "reject_reason": (
            F.when(c("shape").isNull(), "not a CREATE TABLE or CREATE VIEW text")
            .when(c("_opens") & (c("_body_full") == ""), "column list unbalanced")
            .when(~c("_items_ok"), "column list has text outside any item")
            .when(c("_bad_item"), "column item that is not a name and a type")
            .when(c("_pword"), "partition list unbalanced")
            .when(is_table & ~F.coalesce(c("_rest"), F.lit("")).rlike(P.KNOWN_REST),
                  "text after the name or the column list that was not read")),
    })
    # masked texts get their brackets back
    deep = c("_deep")
    plain = lambda x: F.struct(unmask(x["name"]).alias("name"), x["pos"].alias("pos"),
                               unmask(x["type"]).alias("type"), unmask(x["comment"]).alias("comment"))
    d = d.withColumns({
        **{n: F.when(deep, F.transform(n, plain)).otherwise(c(n)) for n in ("columns", "part_columns")},
        "constraints": F.when(deep, F.transform("constraints", unmask)).otherwise(c("constraints")),
        **{n: F.when(deep, unmask(c(n))).otherwise(c(n)) for n in (
            "clustered", "cluster_cols", "skewed", "skewed_on", "as_sql", "options_tail",
            "options", "table_comment")},
    })
    d = d.withColumn("identity", blank_null(F.concat_ws(".", "ident_db", "ident_tbl")))
    keep = [x for x in corpus.columns if x != "ddl"]
    return d.select(
        *keep, "shape", "ident_db", "ident_tbl", *ATTRIBUTES, "cluster_cols", "n_buckets",
        "columns", "part_columns", "constraints", "reject_reason")


def filter_extracted(df: DataFrame, cond: Column) -> DataFrame:
    """Filter on extracted fields without letting Catalyst push the filter
    below the extraction: pushed down, the condition would inline every
    projection stage into one expression tree evaluated without
    subexpression reuse (measured 5x slower). Generator output is never
    pushed through; select the needed columns first so pruning still works."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns])))).filter(cond)


def unnested(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """``keep`` and the fields of each struct of ``array``. The outer form is
    used and its empty rows are dropped afterwards: for the inner form Catalyst
    infers a filter on the array and pushes it below the extraction, which then
    runs twice."""
    first = df.schema[array].dataType.elementType.names[0]
    return (df.select(*keep, F.col(array)).select(*keep, F.inline_outer(array))
            .where(F.col(first).isNotNull()))


def def_columns(defs: DataFrame) -> DataFrame:
    """db, tbl, v, pos, name, type, comment — one row per column."""
    return unnested(defs, "columns", "db", "tbl", "v").select(
        "db", "tbl", "v", "pos", "name", "type", "comment")


def def_part_columns(defs: DataFrame) -> DataFrame:
    return unnested(defs, "part_columns", "db", "tbl", "v").select(
        "db", "tbl", "v", "pos", "name", "type", "comment")


def def_constraints(defs: DataFrame) -> DataFrame:
    return (defs.select("db", "tbl", "v", F.explode_outer("constraints").alias("text"))
            .where(F.col("text").isNotNull()))


def def_attrs(defs: DataFrame) -> DataFrame:
    return defs.select("db", "tbl", "v", "shape", *ATTRIBUTES)


def rejected(defs: DataFrame) -> DataFrame:
    return filter_extracted(defs.select("db", "tbl", "v", "shape", "reject_reason"),
                            F.col("reject_reason").isNotNull())


extract_definition = definitions            # E19
