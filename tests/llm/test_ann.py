"""Nearest neighbours against brute force."""
import numpy as np
from pyspark.sql import functions as F

from schemaloom.llm import ann


def brute(rows, k):
    rows = sorted(set(rows))
    out = {}
    for q, v in rows:
        if q % 20:
            continue
        cand = [(-float((np.array(w, np.float64) * np.array(v, np.float64)).sum()), i)
                for i, w in rows if i != q]
        out[q] = [i for _, i in sorted(cand)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn(
        "block", F.lit("x")).withColumn("rank", F.lit("y"))


def found(spark, rows, k=20):
    df = frame(spark, rows)
    out = {}
    for r in sorted(ann.nearest(df, df.where("vec_id % 20 = 0"), k).collect(),
                    key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall_and_rank(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 300)
    monkeypatch.setattr(ann, "QUERIES", 16)
    rng = np.random.default_rng(5)
    rows = [(i, tuple(np.float32(rng.normal(i % 7, 1, 24)).tolist())) for i in range(1000)]
    got, want = found(spark, rows), brute(rows, 20)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.98 * 20 * len(want)


def test_ties_repeats_and_unusable(spark):
    rng = np.random.default_rng(6)
    base = tuple(np.float32(rng.normal(0, 1, 8)).tolist())
    rows = [(i, base) for i in range(200)] + [(200, tuple(-x for x in base))]
    extra = [(7, base), (7, base), (300, None), (320, (0.0,) * 8), (340, (float("nan"),) + base[1:]),
             (360, (None,) + base[1:]), (380, (float("inf"),) + base[1:]), (400, (1.0, 2.0)),
             (None, base)]
    got = found(spark, rows + extra)
    for q, ids in got.items():
        if q < 200:  # ties go to the smaller id
            assert ids == [i for i in range(21) if i != q][:20]
    assert sorted(got) == list(range(0, 201, 20))


def test_few_and_empty(spark):
    assert found(spark, [(0, (1.0, 0.0)), (1, (0.5, 0.5)), (2, (2.0, 0.0))]) == {0: [2, 1]}
    assert found(spark, [(0, (1.0, 0.0))]) == {}
    assert found(spark, []) == {}
