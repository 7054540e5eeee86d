"""Decontamination against a brute-force search of windows."""
import re

import duckdb
import pytest

from schemaloom.llm import decontaminate as D
from schemaloom.llm.oracle import ORACLE
from schemaloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "the quick brown fox jumps over a lazy dog while seven black cats watch from the roof"
ITEMS = [(1, LONG), (2, "Zwölf Boxkämpfer jagen"), (3, "word"), (4, None), (5, ""), (6, "..."),
         (7, LONG + " and then some more words"), (8, "a b a b a b a b a b a b a b a b a b"),
         (1, LONG), (9, "tick tock tick")]


def brute(rows, items):
    wins = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        m = min(13, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[j:j + m]), set()).add(str(i))
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        hit, ids = set(), set()
        for m in {len(x) for x in wins}:
            for j in range(len(w) - m + 1):
                if (own := wins.get(tuple(w[j:j + m]))):
                    hit |= set(range(j, j + m))
                    ids |= own
        out.append((i, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rows_of(odd_rows):
    w = LONG.split()
    texts = [LONG, "x " * 30 + LONG.upper() + " y" * 500, " ".join(w[:12]), " ".join(w[1:14]),
             " ".join(w[:7] + ["no"] + w[7:]), "Zwölf  Boxkämpfer, jagen!", "zwölf boxkämpfer",
             "ZWÖLF boxkämpfer jagen", "a b " * 40, LONG + " and then " + LONG, "b a " * 7]
    return odd_rows + [(50 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("few", [D.BROADCAST_ROWS, 0])
def test_equals_brute_force(spark, docs_of, odd_rows, monkeypatch, few):
    monkeypatch.setattr(D, "BROADCAST_ROWS", few)  # 0: the shuffled joins
    rows = rows_of(odd_rows)
    bench = spark.createDataFrame(ITEMS, "item_id int, text string").selectExpr("*", "1 AS words")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated)
           for r in D.contamination(docs_of(rows), bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, ITEMS)))


def test_empty_tables(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], "item_id int, text string")
    got = D.contamination(docs_of(odd_rows), none).collect()
    assert len(got) == len(odd_rows) and not any(r.n_hit or r.contaminated for r in got)
    assert D.contamination(docs_of([]), spark.createDataFrame(ITEMS, none.schema)).collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        path = f"{sf}/{t}.parquet"
        try:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
        except duckdb.IOException:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    want = con.sql(ORACLE["op4_decontaminate"])
    got = QUERIES["op4_decontaminate"](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert any(r.contaminated for r in got)
