"""Filter audit against a plain walk through every order, document by document."""
import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from schemaloom.llm import filteraudit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def plain(docs, labels):
    """{(part, order, step): counts} and {(part, letter): removed over all orders}."""
    def fails(i, text):
        text = text or ""
        words = [w for w in re.split(r"[ \t-\r]+", text) if w]
        twin = i is not None and any(j is not None and j < i and (t or "") == text
                                     for j, t, _ in docs)
        return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
                "D": any(c in "#$%&*|" for c in text), "E": twin}
    rows = [(s or "", fails(i, t),
             any(j is not None and j == i and q == 1 for j, q, _ in labels),
             any(j is not None and j == i and x == 1 for j, _, x in labels)) for i, t, s in docs]
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, letter in enumerate(order, 1):
                n = Counter()
                for k, (p, fail, good, toxic) in enumerate(rows):
                    if p != part:
                        continue
                    n["unique_fails"] += fail[letter] and sum(fail.values()) == 1
                    if k in gone:
                        n["redundant"] += fail[letter]
                    elif fail[letter]:
                        gone.add(k)
                        n.update(removed=1, good_lost=good, toxic_lost=toxic)
                    else:
                        n["kept"] += 1
                out[part, "".join(order), step] = tuple(n[c] for c in COUNTS)
                shapley[part, letter] += n["removed"]
    return out, shapley


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    d = (d.withColumn("mask", F.lit("m")).withColumn("part", F.lit(7)).withColumn("n", F.lit("n"))
         .withColumn("_id", F.lit("x")).withColumn("quality", F.lit(1)).withColumn("step", F.lit(0)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return d, lab.withColumn("text", F.lit("clash"))


def cases(odd_rows):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(i, t, "s" if k % 3 else None) for k, (i, t) in enumerate(odd_rows)]
    docs += [(20, long, "s"), (21, long, "t"), (22, long + " 50%", ""), (23, long.upper(), "t"),
             (24, long, "s"), (24, long, "t"), (24, "other #", "s"), (None, long, "s"),
             (None, None, None), (-1, "word", "t"), (30, long, "s"), (31, "\x0b\x1c w", "s")]
    labels = [(20, 1, 0), (20, 0, 1), (21, None, 1), (24, 1, 1), (24, 1, 1), (None, 1, 1),
              (99, 1, 1), (4, 1, None), (-1, 0, 0)]
    return docs, labels


@pytest.mark.parametrize("broadcast", [filteraudit.BROADCAST_ROWS, 0])
def test_audit_equals_plain_walk(spark, odd_rows, monkeypatch, broadcast):
    monkeypatch.setattr(filteraudit, "BROADCAST_ROWS", broadcast)
    docs, labels = cases(odd_rows)
    want, shapley = plain(docs, labels)
    got = filteraudit.audit(*frames(spark, docs, labels)).collect()
    assert len(got) == len(want) == 600 * len({p for p, *_ in want})
    for r in got:
        assert tuple(r[c] for c in COUNTS) == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_large_group_of_copies(spark):
    """All but one row are copies; the sums of a part are its documents."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"),
                                    F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in filteraudit.audit(docs, labels).collect()}
    assert got["a", "EABCD", 1].removed == 2499 and got["b", "EABCD", 1].removed == 2500
    assert got["a", "ABCDE", 5].redundant == 2499 and got["a", "ABCDE", 1].removed == 2500
    assert got["a", "ABCDE", 1].shapley + got["a", "ABCDE", 5].shapley == 2500 * math.factorial(5)


def test_empty(spark):
    assert filteraudit.audit(*frames(spark, [], [])).collect() == []


def test_many_labels_are_not_broadcast(spark, monkeypatch):
    """Labels counted as too many for a broadcast are shuffled, however small the
    planner takes their file to be."""
    monkeypatch.setattr(filteraudit, "BROADCAST_ROWS", 2)
    docs = spark.createDataFrame([(i, f"k{i}".encode()) for i in (1, 2, 3, 4, None)],
                                 "_id long, _key binary")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (9, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    found = filteraudit.labelled(docs, labels)
    got = {r["_id"]: (r["_good"], r["_toxic"]) for r in found.collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (1, 1), 4: (0, 0), None: (0, 0)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
