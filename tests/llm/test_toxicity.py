"""Exactness of the block-max search; accuracy on held-out labels; odd rows."""
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from schemaloom.llm import toxicity
from schemaloom.llm.common import fold, table
from schemaloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_search_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for i in range(500):
        at = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        w = rng.random(len(at)) + 0.1
        vectors.append((at.astype(np.int64), w / np.sqrt((w * w).sum()) if len(at) else w))
    vectors += vectors[:30]  # ties
    index = toxicity.BlockMaxIndex(vectors, 40, block=16)
    dense = np.zeros((len(vectors), 40))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for at, w in vectors[:200]:
        cos = dense[:, at] @ w
        want = np.lexsort((np.arange(len(cos)), -np.round(cos, 12)))[:15]
        want = want[cos[want] > 0]
        got, score = index.search(at, w, 15)
        assert got.tolist() == want.tolist()
        assert np.allclose(score, cos[want])


def test_search_of_many_is_exact(monkeypatch):
    """Common and rare terms, several chunks of postings, queries without a
    term, and a floor under which products may be missing."""
    monkeypatch.setattr(toxicity, "AT_ONCE", 50)
    rng = np.random.default_rng(5)

    def vector():
        at = np.unique(np.concatenate([rng.choice(8, 3), 8 + rng.integers(0, 300, 12)]))
        w = rng.random(len(at)) + 0.05
        return at.astype(np.int32), w / np.sqrt((w * w).sum())
    vectors = [vector() for _ in range(400)]
    index = toxicity.BlockMaxIndex(vectors, 308, block=16)
    assert 0 < len(index.dense) < 308
    dense = np.zeros((400, 308))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w.astype(np.float32)
    queries = [vector() for _ in range(60)] + [(np.zeros(0, np.int32), np.zeros(0))]
    flat = (np.concatenate([a for a, _ in queries]), np.concatenate([w for _, w in queries]),
            np.cumsum([0, *(len(a) for a, _ in queries)]))
    for low in (0.0, 0.5):
        got = index.search_all(flat, 15, np.zeros(308), np.full(61, low))
        for (at, w), (number, cos) in zip(queries, got):
            every = dense[:, at] @ w
            want = np.lexsort((np.arange(400), -np.round(every, 12)))[:15]
            want = want[(every[want] > 0) & (every[want] >= low)]
            assert number[:len(want)].tolist() == want.tolist()
            assert np.allclose(cos[:len(want)], every[want])


def test_frequent_terms_have_small_numbers(spark, docs_of):
    rows = [(i, "shared" + " other" * (i % 2) + f" word{i}") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(rows), labels)
    model.neighbours(["shared"])
    space = model.space
    assert sorted(space.number.tolist()) == list(range(len(space.terms)))

    def numbers(word):
        h, _ = toxicity.term_hashes([word])
        return space.number[np.searchsorted(space.terms, h)]
    own = numbers("word7")[~np.isin(numbers("word7"), numbers("word8"))]
    assert numbers("shared").max() < numbers("other").min() and numbers("other").max() < own.min()


def test_index_holds_postings_alone():
    """Nothing but the vectors, the postings and some numbers a term stays in memory."""
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(300):
        at = np.sort(rng.choice(2000, 300, replace=False)).astype(np.int32)
        vectors.append((at, np.full(300, 300 ** -0.5)))
    index = toxicity.BlockMaxIndex(vectors, 2000)
    size = sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray))
    assert size < 300 * 300 * 16 + 2000 * 100


def test_like_examples_share_shards(spark, docs_of, monkeypatch):
    """Examples are grouped by what they are like, not by their numbers."""
    monkeypatch.setattr(toxicity, "SHARD", 1500)
    kinds = ["the quiet river runs along these hills", "viele kleine Haeuser stehen dort"]
    rows = [(i, f"{kinds[i % 2]} {i}") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(rows), labels)
    model.neighbours(["the river"])
    mixed = 0
    for name in model.shards:
        own = {int(model.ids[no]) % 2 for no in model._shard(name)[0].tolist()}
        mixed += len(own) > 1
    assert len(model.shards) >= 3 and mixed <= 1


def test_find_is_a_search():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 3000):
        terms = np.sort(rng.integers(-2 ** 63, 2 ** 63 - 1, n))
        space = toxicity.Space(terms, np.arange(n, dtype=np.int32), np.ones(n))
        h = np.concatenate([terms, terms + 1, rng.integers(-2 ** 63, 2 ** 63 - 1, 500)])
        place = {x: i for i, x in enumerate(terms.tolist())}
        assert space.find(h).tolist() == [place.get(x, -1) for x in h.tolist()]


def test_held_out_accuracy(spark):
    got = (QUERIES["op3_toxicity"](spark, SF).join(table(spark, SF, "labels"), "doc_id")
           .where("held_out").groupBy("toxic", "predicted").count().collect())
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    right = n.get((0, 0), 0) + n.get((1, 1), 0)
    assert right >= 0.95 * sum(n.values())


def test_odd_rows_and_clashing_columns(spark, docs_of, odd_rows):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels").where(fold(F.col("doc_id"), 5) != 0))
    got = toxicity.score(docs_of(odd_rows), model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not r.text} == {model.score("")[0]}
    assert got[0].class_id == -1  # other columns stay
    s, evidence = model.score("You idiot, you worthless clown and moron")
    assert s > 0.5 and evidence and all(no in model.ids and c > 0 for no, c in evidence)


def test_nothing_labelled(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs_of(odd_rows), toxicity.fit(docs_of(odd_rows), labels)).collect()
    assert len(got) == len(odd_rows) and {r.predicted for r in got} == {0}
    assert toxicity.score(docs_of([]), toxicity.fit(docs_of([]), labels)).collect() == []


def test_few_examples_span_the_space(spark, docs_of):
    """No number of examples is too small for a term: texts find what they share words with."""
    rows = [(i, f"you idiot number{i}") for i in range(3)] + [(i, f"a calm day number{i}")
                                                             for i in range(3, 12)]
    labels = spark.createDataFrame([(i, int(i < 3)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(rows), labels)
    score, evidence = model.score("what an idiot")
    assert score > 0.5 and {model.ids[no] for no, _ in evidence} == {"0", "1", "2"}
    assert model.ids[model.score("number7")[1][0][0]] == "7"


def test_small_table_has_neighbours(spark):
    """sf0.001 has 58 and 10 examples; every toxic one finds itself."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    known = table(spark, "/root/testdata/sf0.001", "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(docs, known)
    toxic = docs.join(known.where("toxic = 1"), "doc_id").select("doc_id", "text").collect()
    assert toxic
    for (score, evidence), r in zip(model.score_all([r.text for r in toxic]), toxic):
        if (r.text or "").strip():
            assert any(no % 2 == 1 and cos > 1 - 1e-5 for no, cos in evidence)


def terms_of(word):
    marked = f"<{word}>"
    return {marked} | {marked[i:i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}


def test_term_hashes_tell_terms_apart():
    words = ["a", "ab", "abc", "abcd", "idiot", "tick" * 50, "Ärger", "ab", "bc", "x" * 3000]
    h, n = toxicity.term_hashes(words)
    want = [terms_of(w) for w in words]
    assert n.tolist() == [len(x) for x in want]
    own = np.split(h, np.cumsum(n)[:-1])
    assert len({x for a in own for x in a.tolist()}) == len(set().union(*want))
    for a, x in zip(own, want):
        for b, y in zip(own, want):
            assert len(np.intersect1d(a, b)) == len(x & y)
    assert [len(x) for x in toxicity.term_hashes([])] == [0, 0]


def brute_force(rows, sample, population):
    """Raw scores of texts by the definition: all cosines in plain Python."""
    def tf(text):
        count = Counter()
        for word, n in Counter(toxicity.words(text or "")).items():
            count.update(dict.fromkeys(terms_of(word), n))
        return count
    held = [(tf(text), y, no) for text, y, no in sample]
    size = Counter(y for _, y, _ in held)
    n, seen = len(held), {0: Counter(), 1: Counter()}
    for count, y, _ in held:
        seen[y].update(count.keys())
    idf = {}
    for t in seen[0].keys() | seen[1].keys():
        a, b = seen[0][t], seen[1][t]
        phi = abs(b * (size[0] - a) - a * (size[1] - b)) / math.sqrt(
            max(size[0] * size[1], 1) * (a + b) * max(n - a - b, 1))
        idf[t] = (math.log((1 + n) / (1 + a + b)) + 1) * (phi + 1 / n)

    def unit(count):
        w = {t: (1 + math.log(c)) * idf[t] for t, c in count.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}
    vectors = [(unit(count), y, no) for count, y, no in held]
    weight = [population[c] / max(size[c], 1) for c in (0, 1)]
    total = weight[0] * size[0] + weight[1] * size[1]
    prior = (weight[1] * size[1] + 0.1) / (total + 1)
    out = []
    for text in rows:
        q = unit(tf(text))
        cos = sorted(((-sum(x * v.get(t, 0) for t, x in q.items()), no, y)
                      for v, y, no in vectors))[:toxicity.K]
        votes = [(-c * weight[y], y) for c, _, y in cos if c < 0]
        out.append((sum(v * y for v, y in votes) + toxicity.PRIOR_WEIGHT * prior)
                   / (sum(v for v, _ in votes) + toxicity.PRIOR_WEIGHT))
    return out


def test_whole_score_is_that_of_brute_force(spark, monkeypatch):
    """Terms, weights, search over several shards, votes and prior; then the
    curve, which keeps the order of the raw scores."""
    monkeypatch.setattr(toxicity, "SHARD", 20_000)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    known = table(spark, "/root/testdata/sf0.001", "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(docs, known)
    assert len(model.shards) > 1
    sample = [(r.text, r.toxic, r.no) for r in toxicity.examples(docs, known).collect()]
    rows = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["", "zzz qqq", None]
    want = brute_force(rows, sample, Counter(y for _, y, _ in sample))
    got = [model.raw(*x) for x in model.neighbours([t or "" for t in rows])]
    assert np.allclose(got, want, atol=1e-5)
    scores = [s for s, _ in model.score_all([t or "" for t in rows])]
    slope, shift = model.curve
    assert slope > 0
    assert np.allclose(scores, [1 / (1 + math.exp(-(slope * math.log(p / (1 - p)) + shift)))
                                for p in got])


def test_curve_corrects_raw_scores():
    rng = np.random.default_rng(2)
    raw = rng.random(4000)
    true = 1 / (1 + np.exp(-(2 * np.log(raw / (1 - raw)) - 1)))
    slope, shift = toxicity.logistic(raw, (rng.random(4000) < true).astype(int), np.ones(4000))
    assert abs(slope - 2) < 0.2 and abs(shift + 1) < 0.2
    assert toxicity.logistic(raw, np.zeros(4000, int), np.ones(4000)) == (1.0, 0.0)


def test_repeated_labelled_ids(spark, docs_of):
    """The smallest text of an id counts, and an id once, however often it is labelled."""
    rows = [(1, "b b"), (1, "a a"), (1, None), (2, None), (2, None)]
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (None, 1), (9, 1)],
                                   "doc_id long, toxic int")
    got = toxicity.examples(docs_of(rows), labels).collect()
    assert sorted((r.doc_id, r.text, r.toxic) for r in got) == [(1, "a a", 1), (2, None, 0)]
    assert {r.no % 2 == r.toxic for r in got} == {True}
