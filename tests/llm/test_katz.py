"""Katz scores against a plain implementation; normalisation; odd rows."""
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import katz
from schemaloom.llm.common import fold, table

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def good_turing(counts, total):
    n = Counter(counts.values())
    for k in range(katz.KEPT, 0, -1):
        if any(n[r] == 0 for r in range(1, k + 2)):
            continue
        a = (k + 1) * n[k + 1] / n[1]
        if a == 1:
            continue
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)}
        if all(0 < x < 1 for x in d.values()):
            return lambda c: c * d.get(c, 1.0)
    return lambda c: c * total / (total + max(len(counts), 1))


class Plain:
    def __init__(self, rows):
        self.uni, self.bi, self.ctx = Counter(), Counter(), Counter()
        for _, text, learn in rows:
            if learn:
                prev = "<s> "
                for w in self.tokens(text):
                    self.uni[w] += 1
                    self.bi[prev, w] += 1
                    self.ctx[prev] += 1
                    prev = w
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.du, self.db = good_turing(self.uni, self.n), good_turing(self.bi, self.n)
        self.unknown = 1 - sum(map(self.du, self.uni.values())) / self.n if self.n else 1.0
        follow = defaultdict(list)
        for (a, b), c in self.bi.items():
            follow[a].append((b, c))
        self.back = {}
        for a, seen in follow.items():
            total, kept = self.ctx[a], sum(self.db(c) for _, c in seen)
            total += kept >= total * (1 - 1e-12)
            self.back[a] = total, (1 - kept / total) / (1 - sum(self.p(b) for b, _ in seen))

    @staticmethod
    def tokens(text):
        return [*TOKEN.findall((text or "").translate(LOW)), "</s> "]

    def p(self, w):
        return self.du(self.uni[w]) / self.n if self.uni[w] else self.unknown

    def given(self, prev, w):
        if self.bi.get((prev, w)):
            return self.db(self.bi[prev, w]) / self.back[prev][0]
        return self.back[prev][1] * self.p(w) if prev in self.back else self.p(w)

    def score(self, text):
        out, prev = 0.0, "<s> "
        for w in self.tokens(text):
            out += math.log10(max(self.given(prev, w), 1e-300))
            prev = w
        return out


def compare(spark, rows):
    df = (spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
          .withColumn("score", F.lit("x")).withColumn("tokens", F.lit(1)))
    got = katz.score(df).collect()
    plain = Plain(rows)
    want = []
    for i, t, learn in rows:
        w = plain.tokens(t)
        base = sum(math.log10((plain.uni[x] + .5) / (plain.n + .5 * (plain.v + 1))) for x in w)
        want.append((i, bool(learn), len(w), sum(plain.uni[x] > 0 for x in w), plain.n, base,
                     plain.score(t)))
    key = lambda r: (repr(r[:5]), r[5])
    mine = sorted(((r.doc_id, r.learn, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                   for r in got), key=key)
    for a, b in zip(mine, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-5, abs=1e-5)
    return plain


def test_equals_plain_model(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK", 100_000)  # several blocks
    monkeypatch.setattr(katz, "WORDS_AT_ONCE", 50_000)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text, r.learn) for r in
            docs.select("doc_id", "text", (fold(F.col("doc_id"), 5) != 1).alias("learn")).collect()]
    rows += [(i, t, n % 2 == 0) for n, (i, t) in enumerate(odd_rows)] + [(999, "a", None)]
    plain = compare(spark, rows)
    for prev in ["<s> ", "the", "tick", "never seen "]:  # each context sums to 1
        total = sum(plain.given(prev, w) for w in plain.uni) + plain.given(prev, "unknown ")
        assert total == pytest.approx(1, abs=1e-9)


def test_little_data(spark):
    compare(spark, [(1, "a b a", True), (2, "", False), (3, "z a", False)])
    compare(spark, [(1, "a a a a a a a a", True)])
    compare(spark, [(1, "a b", False), (2, None, False)])  # nothing learned
    empty = spark.createDataFrame([], "doc_id long, text string, learn boolean")
    assert katz.score(empty).collect() == []


def test_discount_fallback():
    n = np.array([0, 5, 0, 0, 0, 0, 0])
    d = katz.Discount.of(n, 100, 25)
    assert np.allclose(d.counts(np.array([1, 7])), [0.8, 5.6])
