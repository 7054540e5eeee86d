"""Column expressions used by extraction, diff and reports.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it runs JVM-side inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

# --- fixed values ----------------------------------------------------------
# file-name timestamp of a captured definition: day_month_year_hour_min_sec
STAMP_FORMAT = "dd_MM_yyyy_HH_mm_ss"
# ---------------------------------------------------------------------------


def rx(col: Column, pattern: str, group: int = 0) -> Column:
    """regexp_extract that yields NULL instead of '' when nothing matched."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def rx_all(col: Column, pattern: str) -> Column:
    """All whole matches of ``pattern`` (group 0) as ARRAY<STRING>."""
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names
    it: outside a generated projection Catalyst shares no subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_null(value: Column) -> Column:
    """NULL for the empty string; ``value`` is computed once."""
    return once(value, lambda x: F.when(x != "", x))


SEP = "\u0001"


def groups(col: Column, pattern: str, n: int) -> Column:
    """Groups 1..n of an anchored whole-text ``pattern`` from ONE regex pass:
    ARRAY of n strings ('' for a group that did not take part), or NULL when
    the text does not match."""
    template = SEP.join(f"${i}" for i in range(1, n + 1))
    return once(F.split(F.regexp_replace(col, pattern, template), SEP, n),
                lambda out: F.when(F.size(out) == n, out))


def collapse_ws(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def norm_clause(col: Column) -> Column:
    """Canonical form of a clause: outside quotes lower-case with single
    spaces and identifier back-quotes dropped; quoted literals untouched.
    NULL and blank give NULL."""
    def norm(c: Column) -> Column:
        parts = F.transform(
            rx_all(c, P.SEGMENTS),
            lambda s: F.when(s.startswith("'") | s.startswith('"'), s)
            .when(s.startswith("`"), F.lower(F.regexp_replace(s, "`", "")))
            .otherwise(F.lower(F.regexp_replace(s, r"\s+", " "))),
        )
        quoted = F.array_join(parts, "")
        plain = F.lower(F.regexp_replace(c, r"\s+", " "))  # fast path: no quotes
        return F.trim(F.when(has_quote(c), quoted).otherwise(plain))
    return blank_null(once(col, norm))


def has_quote(col: Column) -> Column:
    return col.contains("'") | col.contains('"') | col.contains("`")


def _has_ws(col: Column) -> Column:
    return col.contains(" ") | col.contains("\n") | col.contains("\t") | col.contains("\r")


def norm_ident(col: Column) -> Column:
    """Identifier: back-quotes dropped, lower-case; a partition transform has no
    blanks."""
    return once(F.lower(F.trim(F.replace(col, F.lit("`"), F.lit("")))), lambda x: F.when(
        x.contains("(") | x.contains(P.MASK[0]), blank_null(F.regexp_replace(x, r"\s+", "")))
        .when(x != "", x))


def norm_type(col: Column) -> Column:
    """Type as printed, upper-case, no blanks around , < > ( ) : — comments and
    quoted names of struct fields keep their text."""
    def tight(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), rf"\s*([,<>():{P.MASK}])\s*", "$1")
    quoted = F.trim(F.array_join(F.transform(
        rx_all(col, P.SEGMENTS),
        lambda s: F.when(s.rlike("^['\"`]"), s).otherwise(F.upper(tight(s)))), ""))
    return blank_null(F.when(has_quote(col), quoted).otherwise(
        F.upper(F.when(_has_ws(col), F.trim(tight(col))).otherwise(col))))


def without_comments(sql: Column) -> Column:
    """The statement with SQL comments (-- and /* */) as blanks; comment marks
    inside quotes stay. Texts without any are not walked."""
    tokens = F.transform(rx_all(sql, P.COMMENT_TOKENS),
                         lambda t: F.when(t.rlike(P.SQL_COMMENT), " ").otherwise(t))
    return F.when(sql.contains("--") | sql.contains("/*"), F.array_join(tokens, "")).otherwise(sql)


def unquote(col: Column) -> Column:
    """'text' -> text, with backslash escapes and doubled quotes resolved."""
    inner = col.substr(F.lit(2), F.length(col) - 2)
    mark = col.substr(F.lit(1), F.lit(1))
    plain = (F.when(col.contains("\\"), F.regexp_replace(inner, rf"\\(.)|(['\"])\2", "$1$2"))
             .when(inner.contains("'") & (mark == "'"), F.replace(inner, F.lit("''"), F.lit("'")))
             .when(inner.contains('"') & (mark == '"'), F.replace(inner, F.lit('""'), F.lit('"')))
             .otherwise(inner))
    return plain


def _count(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def nested_deeper(col: Column) -> Column:
    """Is anything nested deeper than the patterns read? One pass finds a
    bracket that opens no group of so many levels: it is deeper or left open.
    Brackets in quotes count too: then masking is not needed but harmless."""
    def left(opens: str, only: str, levels: int) -> Column:
        return ~col.rlike(only) & (_count(col, opens) > levels)
    return (left("(", P.SHALLOW_PARENS, P.PAREN_DEPTH)
            | (col.contains("<") & left("<", P.SHALLOW_ANGLES, P.ANGLE_DEPTH)))


def mask_nested(col: Column) -> Column:
    """The text with all brackets and commas inside a list item replaced by
    the characters of ``patterns.MASK``; NULL if brackets don't pair. Quoted
    text stays. Only for texts that need it: it walks token by token."""
    opens, closes, comma, less, more = (F.lit(c) for c in P.MASK)
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("d"), F.lit(0).alias("a"))

    def step(acc, t):
        s, d, a = acc["s"], acc["d"], acc["a"]
        in_list, nested = d >= 1, (d > 1) | (a > 0)
        angle = in_list & (d == 1)
        return F.struct(
            F.concat(s, F.when((t == "(") & in_list, opens)
                     .when((t == ")") & (d > 1), closes)
                     .when((t == ",") & in_list & nested, comma)
                     .when((t == "<") & in_list, less)
                     .when((t == ">") & in_list, more).otherwise(t)).alias("s"),
            (d + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("d"),
            (a + F.when(angle & (t == "<"), 1).when(angle & (t == ">"), -1).otherwise(0)).alias("a"))
    end = F.aggregate(rx_all(col, P.MASK_TOKENS), start, step)
    return F.when((end["d"] == 0) & (end["a"] == 0), end["s"])


def unmask(col: Column) -> Column:
    return F.translate(col, P.MASK, P.UNMASKED)


def name_parts(name: Column) -> Column:
    """``a.b.c`` (back-quotes allowed) -> ARRAY of lower-case parts."""
    return F.transform(
        rx_all(name, r"`[^`]++`|\w+"), lambda p: F.lower(F.regexp_replace(p, "`", "")))


def column_line(name: Column, type_: Column, comment: Column) -> Column:
    """``name TYPE[ COMMENT 'text']`` — one printed column."""
    return F.concat(
        name,
        F.coalesce(F.concat(F.lit(" "), type_), F.lit("")),
        F.coalesce(F.concat(F.lit(" COMMENT '"), comment, F.lit("'")), F.lit("")),
    )


def version_stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP_FORMAT)


def parse_stamp(s: Column) -> Column:
    return F.try_to_timestamp(s, F.lit(STAMP_FORMAT)).cast("timestamp_ntz")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalise_text(col: Column) -> Column:
    """The text normaliser of §2.9, the same in any engine: runs of blank, tab,
    line feed, vertical tab, form feed and carriage return become one blank,
    blanks at the ends go, A-Z become a-z. All other characters stay."""
    spaced = F.regexp_replace(col, r"[ \t\n\x0B\f\r]+", " ")
    return F.translate(F.btrim(spaced, F.lit(" ")), _UPPER, _UPPER.lower())
