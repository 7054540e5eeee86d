"""Regular expressions for reading CREATE TABLE / CREATE VIEW text.

All patterns are Java regexes evaluated by Spark's built-in regexp
functions. Repetition of groups is possessive (``*+`` / ``++``): Java runs
possessive group loops iteratively, so texts with thousands of columns do
not overflow the stack, and nothing backtracks.

The patterns themselves read parentheses nested up to ``PAREN_DEPTH`` and
angle brackets up to ``ANGLE_DEPTH``. Deeper text is first masked
(``functions.text.mask_nested``): everything nested inside a list item becomes
private-use characters, so any depth is read exactly by the same patterns.
"""

from __future__ import annotations

PAREN_DEPTH = 2
ANGLE_DEPTH = 5

# --- fixed values: DDL grammar words recognised by the extractor ----------
TABLE_KINDS = r"external|temporary|global\s+temporary|transient|managed"
CONSTRAINT_WORDS = r"primary\s+key|foreign\s+key|unique|check"
CLAUSE_START = (r"like|using|options|comment|partitioned\s+by|clustered\s+by|cluster\s+by|sorted\s+by"
                r"|skewed\s+by|row\s+format|stored\s+(?:as|by)|location|tblproperties"
                r"|default\s+collation|with\s+serdeproperties|as")
TAIL_START = r"row\s+format\b|stored\s+as\b(?!\s+directories)|location\b|tblproperties\b"
CTAS_START = r"as\s+(?:select|with|from|values|table)\b|as\s*\("
# ---------------------------------------------------------------------------

# quoted text: 'single', "double" (backslash escapes, doubled quotes), `identifier`
QUOTED = r"""(?:'(?:[^'\\]++|\\.|'')*+'|"(?:[^"\\]++|\\.|"")*+"|`[^`]*+`)"""
_QCH = "'\"`"


def parens(depth: int = PAREN_DEPTH) -> str:
    """Balanced ``( … )`` nested at most ``depth`` levels, quotes kept whole."""
    p = rf"\((?:[^(){_QCH}]++|{QUOTED})*+\)"
    for _ in range(depth - 1):
        p = rf"\((?:[^(){_QCH}]++|{QUOTED}|{p})*+\)"
    return p


def angles(depth: int = ANGLE_DEPTH) -> str:
    """Balanced ``< … >`` nested at most ``depth`` levels; may hold ``(p,s)``."""
    p1 = parens(1)
    a = rf"<(?:[^<>(){_QCH}]++|{p1}|{QUOTED})*+>"
    for _ in range(depth - 1):
        a = rf"<(?:[^<>(){_QCH}]++|{p1}|{QUOTED}|{a})*+>"
    return a


P1 = parens(1)
P2 = parens(2)
PN = parens(PAREN_DEPTH)
AN = angles(ANGLE_DEPTH)

# text inside the column list parentheses
BODY = rf"(?:[^(){_QCH}]++|{QUOTED}|{PN})*+"
# one comma-separated list item
ITEM = rf"(?:[^,()<>{_QCH}]++|{QUOTED}|{PN}|{AN})++"



def shallow(opens: str, closes: str, depth: int) -> str:
    """Texts whose every ``opens`` begins a group of at most ``depth`` levels,
    quotes not looked at."""
    g = rf"{opens}[^{opens}{closes}]*+{closes}"
    for _ in range(depth - 1):
        g = rf"{opens}(?:[^{opens}{closes}]++|{g})*+{closes}"
    return rf"^(?:[^{opens}]++|{g})*+$"


SHALLOW_PARENS = shallow(r"\(", r"\)", PAREN_DEPTH)
SHALLOW_ANGLES = shallow("<", ">", ANGLE_DEPTH)

# private-use characters that stand for ( ) , < > in masked text
MASK = "\ue000\ue001\ue002\ue003\ue004"
UNMASKED = "(),<>"
MASKED = rf"{MASK[0]}.*{MASK[1]}"
# pieces of a text for masking: quoted text, one bracket or comma, anything else
MASK_TOKENS = rf"{QUOTED}|[(),<>]|[^(),<>{_QCH}]++|[{_QCH}]"

# dot-separated identifiers, plain or back-quoted; catalogs may nest namespaces
NAME = r"(?:(?:`[^`]++`|\w+)\s*\.\s*){0,7}(?:`[^`]++`|\w+)"

# SQL comments, and the tokens among which they are found (quoted text is one)
SQL_COMMENT = r"^(?:--|/\*)"
COMMENT_TOKENS = rf"{QUOTED}|--[^\n]*+|/\*(?s:.*?)\*/|[^/{_QCH}-]++|[-/{_QCH}]"

# CREATE [OR REPLACE] [kind] TABLE [IF NOT EXISTS] name <after>
TABLE_HEAD = (
    rf"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:({TABLE_KINDS})\s+)?table\s+"
    rf"(?:if\s+not\s+exists\s+)?({NAME})(.*)$"
)
VIEW_HEAD = (
    r"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:(?:global\s+)?temp(?:orary)?\s+)?"
    rf"(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?({NAME})"
)
LIKE_AFTER = rf"(?is)^\s+like\s+({NAME})"
BODY_AFTER = rf"(?is)^\s*\({BODY}\)"
OPENS_PAREN = r"(?s)^\s*\("
INSIDE_PARENS = r"(?s)^\s*\((.*)\)$"

# a list item that is a table constraint: a column may be called check or unique
_OPEN = rf"\s*[({MASK[0]}]"
CONSTRAINT_ITEM = (rf"(?is)^\s*(?:constraint\s+(?:`[^`]++`|\w+)\s+(?:{CONSTRAINT_WORDS})\b"
                   rf"|(?:{CONSTRAINT_WORDS}){_OPEN})")
# what may follow the name and the column list
KNOWN_REST = rf"(?is)^\s*(?:;?\s*$|(?:{CLAUSE_START})\b)"
# name type, then in any order NOT NULL, COLLATE c, DEFAULT value, GENERATED
# ALWAYS AS (…), COMMENT 'text' and constraints of the one column
_DEFAULT = rf"default\s+(?:(?!\s+(?:not\s+null|comment\s|collate\s))(?:{QUOTED}|{PN}|[^(){_QCH}]))++"
COLUMN_OPTION = (rf"not\s+null|collate\s+[\w.]+|{_DEFAULT}|generated\s+always\s+as\s*(?:{PN}|{MASKED})"
                 rf"|comment\s+({QUOTED})|(?:constraint\s+\w+\s+)?(?:check\s*(?:{PN}|{MASKED})"
                 r"|primary\s+key|unique)|(?:not\s+)?enforced|enable|disable|(?:no)?validate"
                 r"|(?:no)?rely")
COLUMN_ITEM = rf"(?is)^\s*(`[^`]++`|\w+)\s+(?![({MASK[0]}])(.+?)(?:\s+(?:{COLUMN_OPTION}))*\s*$"
# a type holds quoted text only as the comment or the name of a struct field
TYPE_TEXT = (rf"(?is)^[^{_QCH}]*+(?:(?:(?<=\bcomment\s{{1,9}})(?:'(?:[^'\\]++|\\.|'')*+'|\"(?:[^\"\\]++|\\.)*+\")"
             rf"|`[^`]*`)[^{_QCH}]*+)*+$")
# a bare name (untyped partition column), or a partition transform such as
# days(ts) or bucket(16, id)
BARE_ITEM = (rf"(?is)^\s*(`[^`]++`|\w+(?:\s*(?:\([^()]*+\)"
             rf"|{MASK[0]}[^{MASK[0]}{MASK[1]}]*+{MASK[1]}))?)\s*$")


def skip_to(stop: str) -> str:
    """Prefix that walks whole words, quoted text and parenthesised groups
    until a word where ``stop`` matches. Keywords inside quotes or inside a
    column list never stop it (e.g. a column comment saying 'location')."""
    return (
        rf"(?:[^\w(){_QCH}]++|{QUOTED}|{PN}|(?!(?:{stop}))\w++|[(){_QCH}])*+"
    )


def clause(stop: str, rest: str) -> str:
    """Anchored pattern: skip to the first ``stop`` word, then match ``rest``."""
    return rf"(?is)^{skip_to(stop)}{rest}"


PARTITIONED = clause(r"partitioned\s", rf"partitioned\s+by\s*(\({BODY}\))")
PARTITIONED_WORD = clause(r"partitioned\s", r"partitioned\s+by\b")
CLUSTERED = clause(
    r"cluster(?:ed)?\s",
    rf"(cluster(?:ed)?\s+by\s*({P1})(?:(?:\s*sorted\s+by\s*{P1})?\s*into\s+(\d+)\s+buckets)?)(?s:.*)$",
)
SKEWED = clause(r"skewed\s", rf"(skewed\s+by\s*{P1})(?:\s*(on\s*{P2}))?(\s+stored\s+as\s+directories)?(?s:.*)$")
OPTIONS = clause(r"options\s*\(", rf"options\s*(\({BODY}\))")
PROVIDER = clause(r"using\s", r"using\s+([\w.]+)")
TABLE_COMMENT = clause(r"comment\s", rf"comment\s+({QUOTED})")
# group 1: clauses before a CTAS query; group 2: the query
CTAS_SPLIT = rf"(?is)^({skip_to(CTAS_START)})(?:as\s*(.*?))?\s*;?\s*$"
TAIL = clause(TAIL_START, r"(.*?)\s*;?\s*$")

# normalisation: split text into quoted and unquoted runs
SEGMENTS = rf"{QUOTED}|[^{_QCH}]++|[{_QCH}]"
