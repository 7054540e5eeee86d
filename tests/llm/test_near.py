"""DartMinHash: agreement estimates, classes against brute force, hot groups."""
import random
from collections import Counter

import numpy as np

from schemaloom.llm import dartminhash as M
from schemaloom.llm.common import Words
from schemaloom.llm.components import components


def grams(text):
    w = Words([text or ""])
    words = [w.word(i) for i in range(len(w))]
    if not words:
        return Counter({("raw", text or ""): 1})
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            a, b = sets[i], sets[j]
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    out = Counter()
    for i, (d, _) in enumerate(rows):
        out[d, None if d is None else min(groups[find(i)])] += 1
    return out


def edited(rng, words, share):
    return " ".join(rng.choice("pqrstuv") * 4 if rng.random() < share else w for w in words)


def test_classes(docs_of, odd_rows):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows = list(odd_rows[:-2]) + [odd_rows[-1]]
    n = 100
    for share in (0, 0.01, 0.02, 0.035, 0.05, 0.1):
        for _ in range(4):
            words = rng.choices(vocab, k=rng.choice([8, 60, 300]))
            rows.append((n, " ".join(words)))
            rows += [(n + 1 + i, edited(rng, words, share)) for i in range(4)]
            n += 10
    rows += [(n, "one two three"), (n + 1, "One, two three!"), (n + 2, "one two"), (n + 3, None),
             (n + 4, "!!! ???"), (n + 5, "???")]
    got = Counter((r.doc_id, r.class_id) for r in M.near_duplicates(docs_of(rows)).collect())
    assert got == brute(rows)


def test_large_bucket_without_star_link(docs_of, monkeypatch):
    """The smallest id is like few members; the others must still meet."""
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "COLUMNS", 50)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    rows = [(0, edited(rng, words, 0.03))]
    rows += [(i, edited(rng, words, 0.022)) for i in range(1, 40)]
    got = Counter((r.doc_id, r.class_id) for r in M.near_duplicates(docs_of(rows)).collect())
    assert got == brute(rows)


def test_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    b[:150] = a[:150]
    b[200:] *= 0.37  # fractional weights
    sig = M.signatures(np.repeat([0, 1], 300), np.concatenate([e, e]), np.concatenate([a, b]), 2,
                       k=4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.035


def test_empty(docs_of):
    assert M.near_duplicates(docs_of([])).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.id: r.class_id for r in
           components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_texts_that_share_an_id(docs_of, odd_rows):
    """Every text of a repeated id is compared, and as itself."""
    rng = random.Random(6)
    words = [["".join(rng.choices("abcdefghij", k=5)) for _ in range(120)] for _ in range(12)]
    rows = list(odd_rows)
    for i, w in enumerate(words):  # id 200 has 12 unlike texts, each with a near copy
        rows += [(200, " ".join(w)), (300 + i, " ".join(w[:-2] + ["end"]))]
    rows += [(None, " ".join(words[0]))]
    got = Counter((r.doc_id, r.class_id) for r in M.near_duplicates(docs_of(rows)).collect())
    assert got == brute(rows)
    kept = [(r.doc_id, r.text) for r in M.one_of_each(docs_of(rows)).collect()]
    assert sorted(x for x in kept if x[0] == 200) == sorted((200, " ".join(w)) for w in words)
    assert sorted(t for i, t in kept if i == 4) == ["other word", "word"]
    assert [t for i, t in kept if i is None] == ["no id here"]


def test_joined_texts_are_not_compared_again(spark, docs_of, monkeypatch):
    """Texts of one cluster are paired with several leads, but what the first
    comparison of each has joined is not compared again."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    rows = [(i, edited(rng, words, 0.008)) for i in range(40)]
    verified, pairs = M.verified, []
    monkeypatch.setattr(M, "verified", lambda p, named: pairs.append(p.count()) or verified(p, named))
    got = Counter((r.doc_id, r.class_id) for r in M.near_duplicates(docs_of(rows)).collect())
    assert got == brute(rows)
    assert {c for _, c in got} == {0}
    assert sum(pairs) < 205  # the pairs that share a bucket
