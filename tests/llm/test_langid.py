"""Byte CNN: gradient, held-out accuracy, odd rows."""
import numpy as np
from pyspark.sql import functions as F

from schemaloom.llm import langid
from schemaloom.llm.common import table
from schemaloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_gradient():
    net = langid.ByteCNN(["a", "b", "c"])
    net.w = {n: x.astype(np.float64) for n, x in net.w.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 256, (3, 20)), np.array([0, 1, 2])

    def loss():
        logit = net.logits(x.astype(np.uint8)).astype(np.float64)
        return np.mean(np.log(np.exp(logit).sum(1)) - logit[np.arange(3), y])
    grad = net._gradient(x, y)
    for name in ("dense", "conv3", "bias2", "emb"):
        flat = net.w[name].reshape(-1)
        for i in np.argsort(-np.abs(grad[name].reshape(-1)))[:4]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - grad[name].reshape(-1)[i]) < 1e-5
            flat[i] = old


def test_windows_cover_the_text():
    raw = [b"", b"x" * 256, b"y" * 700]
    data, doc, length = langid.windows(raw)
    assert doc.tolist() == [1, 2, 2, 2] and length.tolist() == [256, 256, 256, 188]
    assert data[-1, 188:].sum() == 0


def test_held_out_accuracy(spark):
    got = (QUERIES["op10_language"](spark, SF).join(table(spark, SF, "documents"), "doc_id")
           .where("held_out AND lang IS NOT NULL").select("lang", "lang_pred").collect())
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_odd_rows(spark, docs_of, odd_rows):
    net = langid.train(table(spark, SF, "documents"))
    got = langid.predict(docs_of(odd_rows).withColumn("lang_pred", F.lit(3)), net).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        bare = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == bare and 0 <= r.score <= 1
    assert langid.predict(docs_of([]), net).collect() == []


def test_nothing_to_learn(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows).withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(docs) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_rows_without_id_are_thinned(spark, monkeypatch):
    """Rows without id, or of one id, are neither all kept nor all dropped."""
    seen = {}
    monkeypatch.setattr(langid.ByteCNN, "train", lambda self, data, lang: seen.update(
        data={bytes(x).rstrip(b"\0").decode() for x in data}, n=len(data)))
    rows = [(None if i % 3 else i, f"text number {i}", "en") for i in range(900)]
    rows += [(7, f"shared {i}", "de") for i in range(900)] + [(None, "a copy", "fr")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.train(docs, per_lang=100)
    kept = [x for x in seen["data"] if x.startswith("text")]
    own = sum(int(x.split()[-1]) % 3 == 0 for x in kept)
    assert len(kept) == 100 and 10 < own < 60
    assert sum(x.startswith("shared") for x in seen["data"]) == 100
    assert seen["n"] == 201
