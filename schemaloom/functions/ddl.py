"""Per-field Column functions over a DDL text column.

``operators.extract.definitions`` computes all fields at once in staged
projections (each regex once per text); these functions give one field at a
time as a plain Column expression, for use in any ``select`` / ``filter``.
Both use the same grammar (``functions.patterns``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import groups, name_parts, norm_clause, rx_all, unquote, without_comments


def _blank_null(c: Column) -> Column:
    return F.when(c != "", c)


def _head(ddl: Column) -> Column:
    return groups(without_comments(ddl), P.TABLE_HEAD, 3)  # kind, name, text after the name


def _after(ddl: Column) -> Column:
    return _head(ddl)[2]


def balanced_body(ddl: Column) -> Column:
    """Text inside the column-list parentheses (NULL when none)."""
    full = F.regexp_extract(F.coalesce(_after(ddl), F.lit("")), P.BODY_AFTER, 0)
    return F.when(full != "", F.regexp_extract(full, P.INSIDE_PARENS, 1))


def _rest(ddl: Column) -> Column:
    after = F.coalesce(_after(ddl), F.lit(""))
    full = F.regexp_extract(after, P.BODY_AFTER, 0)
    return after.substr(F.length(full) + 1, F.length(after) + 1)


def table_identity(ddl: Column) -> Column:
    """STRUCT(db, tbl), lower-case; views included."""
    view = _blank_null(F.regexp_extract(ddl, P.VIEW_HEAD, 1))
    parts = name_parts(F.coalesce(view, _blank_null(_head(ddl)[1])))
    return F.struct(F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).alias("db"),
                    F.try_element_at(parts, F.lit(-1)).alias("tbl"))


def table_kind(ddl: Column) -> Column:
    """External / temporary / … or NULL."""
    return _blank_null(F.lower(F.regexp_replace(_head(ddl)[0], r"\s+", " ")))


def definition_shape(ddl: Column) -> Column:
    """View / like / table (NULL when not a CREATE TABLE / VIEW text)."""
    return (F.when(ddl.rlike(P.VIEW_HEAD), "view")
            .when(_head(ddl).isNull(), F.lit(None).cast("string"))
            .when(_after(ddl).rlike(P.LIKE_AFTER), "like")
            .otherwise("table"))


def like_source(ddl: Column) -> Column:
    """Source table of CREATE TABLE … LIKE (LIKE must follow the name)."""
    return _blank_null(F.array_join(name_parts(F.regexp_extract(
        F.coalesce(_after(ddl), F.lit("")), P.LIKE_AFTER, 1)), "."))


def view_text(ddl: Column) -> Column:
    """E5: canonical text of a view definition."""
    return F.when(ddl.rlike(P.VIEW_HEAD), norm_clause(ddl))


def split_top_level(body: Column) -> Column:
    """Split on commas outside brackets and quotes (quoted text is
    one unit of the item pattern, never rewritten)."""
    return rx_all(F.coalesce(body, F.lit("")), P.ITEM)


def drop_blank(arr: Column) -> Column:
    """Remove blank strings."""
    return F.filter(arr, lambda x: F.trim(x) != "")


def constraints(ddl: Column) -> Column:
    """Table constraints of the column list, canonical text."""
    items = split_top_level(balanced_body(ddl))
    return F.array_distinct(F.transform(
        F.filter(items, lambda x: x.rlike(P.CONSTRAINT_ITEM)), norm_clause))


def cluster_spec(ddl: Column) -> Column:
    """STRUCT(clause, columns, buckets) of CLUSTERED BY … INTO n BUCKETS."""
    g = groups(_rest(ddl), P.CLUSTERED, 3)
    return F.when(g.isNotNull(), F.struct(
        norm_clause(g[0]).alias("clustered"),
        norm_clause(F.regexp_extract(g[1], P.INSIDE_PARENS, 1)).alias("cluster_cols"),
        _blank_null(g[2]).try_cast("int").alias("n_buckets")))


def skew_columns(ddl: Column) -> Column:
    """SKEWED BY (…) clause."""
    return norm_clause(groups(_rest(ddl), P.SKEWED, 3)[0])


def skew_values(ddl: Column) -> Column:
    """ON (…) clause after SKEWED BY."""
    return norm_clause(groups(_rest(ddl), P.SKEWED, 3)[1])


def skew_directories(ddl: Column) -> Column:
    """E12: 'stored as directories' or NULL."""
    return norm_clause(groups(_rest(ddl), P.SKEWED, 3)[2])


def ctas_query(ddl: Column) -> Column:
    """Query text of CREATE TABLE … AS SELECT."""
    return norm_clause(groups(_rest(ddl), P.CTAS_SPLIT, 2)[1])


def options_tail(ddl: Column) -> Column:
    """Storage tail from the first of row format / stored as / location /
    tblproperties outside quotes, without a CTAS query."""
    rest = _rest(ddl)
    pre = F.coalesce(groups(rest, P.CTAS_SPLIT, 2)[0], rest)
    return norm_clause(groups(pre, P.TAIL, 1)[0])


def table_comment(ddl: Column) -> Column:
    """Table-level COMMENT (outside the column list)."""
    return unquote(_blank_null(F.regexp_extract(_rest(ddl), P.TABLE_COMMENT, 1)))
