"""Metric-tree codes against plain k-means over all entries."""
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import metrictree as mt


def plain(rows):
    """{(vec_id, label, code, error): rows}, label errors and the codebooks' hash."""
    def whole(x):
        return int(x) * 1024 if abs(x) >= 2.0 ** 52 else math.floor(x * 1024)
    kept = [(i, [float(x) for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter(), {}, None
    w = -(-max(len(v) for _, v, _ in kept) // 4)
    cut = [[whole(x) for x in v] + [0] * (4 * w - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    code, error, numbers = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        points = [tuple(c[p * w:p * w + w]) for c in cut]
        book = [list(points[k]) for k in order[:256]]

        def nearest(x):
            d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
            return d.index(min(d))
        for _ in range(4):
            own = [nearest(x) for x in points]
            for e in range(len(book)):
                mine = [x for x, o in zip(points, own) if o == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        for k, x in enumerate(points):
            e = nearest(x)
            code[k] += f"{e:02x}"
            error[k] += sum((a - b) ** 2 for a, b in zip(x, book[e]))
        numbers += [str(x) for e in book for x in e]
    label = Counter()
    for (_, _, y), e in zip(kept, error):
        label[y] += e
    return (Counter((i, y, c, e) for (i, _, y), c, e in zip(kept, code, error)), label,
            hashlib.sha256(",".join(numbers).encode()).hexdigest())


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return (df.withColumn("code", F.lit("clash")).withColumn("error", F.lit("e"))
            .withColumn("vector", F.lit(1)).withColumn("_label", F.lit(0)))


def check(spark, rows, kind="float"):
    want, label, sha = plain(rows)
    names = {}
    for i, y, c, e in want:
        names.setdefault((i, c, e if e < 1 << 63 else None), set()).add(label[y])
    got = mt.compress(frame(spark, rows, kind)).collect()
    assert len(got) == sum(want.values())
    for r in got:
        sums = names[r.vec_id, r.code, r.error]
        assert r.label_error in {s if s < 1 << 63 else None for s in sums}
        assert r.codebooks_sha256 == sha
    told = Counter((r.vec_id, r.code, r.error) for r in got)
    asked = Counter()
    for (i, _, c, e), n in want.items():
        asked[i, c, e if e < 1 << 63 else None] += n
    assert told == asked


def clusters(n, dim, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    return (centre[rng.integers(12, size=n)] + 0.05 * rng.normal(size=(n, dim))).astype(np.float32)


def test_tree_assigns_like_all_entries():
    """Balls hold their points, and owners equal the plain nearest entry."""
    for seed, n, dim in ((1, 3000, 16), (2, 500, 3), (3, 41, 1), (4, 1, 2)):
        points = mt.integers(clusters(n, dim, seed).astype(float))
        points[n // 2:n // 2 + n // 5] = points[0]  # many equal points
        tree = mt.Tree.unpacked(mt.Tree.build(points).packed())
        assert sorted(tree.order.tolist()) == list(range(n))
        for a, b, c, r, s in zip(tree.start, tree.end, tree.centre, tree.radius, tree.total):
            inside = tree.points[a:b]
            assert (inside.sum(axis=0) == s).all()
            assert np.sqrt(((inside / tree.unit - c) ** 2).sum(axis=1)).max() <= r * (1 + 1e-9)
        book = np.concatenate([points[::max(1, n // 60)], points[:3]])  # repeated entries too
        gap = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        code, error = tree.codes(book)
        assert (code == gap.argmin(axis=1)).all() and (error == gap.min(axis=1)).all()
        total, count = tree.sums(book)
        for e in range(len(book)):
            assert (total[e] == points[code == e].sum(axis=0)).all()
            assert count[e] == (code == e).sum()


def test_balls_are_wholly_owned():
    """In clustered data most points go to an entry with their ball, uncompared."""
    points = mt.integers(clusters(4000, 8, 5).astype(float))
    owned = sum(b - a for a, b, e in mt.Tree.build(points).owners(points[:12])
                if isinstance(e, int))
    assert owned > 2000


def test_codes_equal_plain(spark, monkeypatch):
    monkeypatch.setattr(mt, "ROWS", 100)
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(clusters(420, 10, 7))]
    rows += [(1000, None, 1), (1001, [None] * 10, 1), (1002, [float("nan")] + [0.0] * 9, 2),
             (1003, [float("inf")] * 10, 2), (1004, [0.0] * 10, None), (None, [0.5] * 10, None),
             (None, [-0.25] * 10, 1), (7, [2.0] * 10, 3), (7, rows[7][1], 3), (1005, [1.0, -2.0], 9),
             (1006, [], 9)]
    check(spark, rows)


def test_few_rows_and_ties(spark):
    check(spark, [(i, [float(i % 2)] * 4, None) for i in range(9)])
    check(spark, [(3, [0.1, 0.2, 0.3], 1)])


def test_huge_components(spark):
    """Exact beyond 64 bits; errors that a long doesn't hold are null."""
    rows = [(i, [1e300 * (i % 3), -1e18 + i, 3e9 * i, 0.5], i % 2) for i in range(270)]
    check(spark, rows, "double")


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(mt, "BROADCAST_ROWS", 2)
    check(spark, [(i, [i * 0.01] * 4, None if i < 20 else 7 if i < 120 else i)
                  for i in range(1300)])


def test_empty(spark):
    assert mt.compress(frame(spark, [])).collect() == []
    assert mt.compress(frame(spark, [(1, None, 2)])).collect() == []


@pytest.mark.parametrize("value", [0, 1, -1, 5 << 40, -(1 << 40), (1 << 200) - 3, -(1 << 99) + 7])
def test_limbs(value):
    assert sum(low << (mt._LIMB * at) for at, low in mt.limbs(value)) == value
