"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows,
each filter's maximum over the window goes to a softmax layer. It is trained
on a bounded sample: at most SAMPLE_PER_LANG documents per language, at most
WINDOW bytes of each, chosen by hash (a threshold leaves about twice as many
before they are ranked). Prediction covers every window of the whole text; the windows'
logits are averaged by their lengths.

Because an embedded byte times a filter column is a table of 256 rows, the
convolution over a batch of windows is a sum of table look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, texts, thinned

WINDOW = 256
SAMPLE_PER_LANG = 600
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
STEPS = 500
BATCH = 64
RATE = 0.01
SEED = 20240102
UNKNOWN = "und"
SLICE = 2 << 20

_LETTER = regex.compile(r"\p{L}")


def windows(raw: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all windows (zero-padded), their text and their true length."""
    count = np.array([-(-len(r) // size) for r in raw], np.int64)
    doc = np.repeat(np.arange(len(raw)), count)
    data = np.frombuffer(b"".join(r.ljust(c * size, b"\0") for r, c in zip(raw, count.tolist())),
                         np.uint8).reshape(-1, size)
    length = np.full(len(doc), size, np.int64)
    ends = np.cumsum(count) - 1
    for d in np.flatnonzero(count).tolist():
        length[ends[d]] = len(raw[d]) - (count[d] - 1) * size
    return data, doc, length


class ByteCNN:
    """Weights: emb (256 x EMBED, row 0 stays zero), conv[w] (w*EMBED x FILTERS),
    bias[w], dense, dense_bias."""

    def __init__(self, langs: list[str]):
        rng = np.random.default_rng(SEED)
        self.langs = langs
        self.w = {"emb": rng.normal(0, 0.5, (256, EMBED)),
                  "dense": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))),
                  "dense_bias": np.zeros(len(langs))}
        for k in WIDTHS:
            self.w[f"conv{k}"] = rng.normal(0, 1 / np.sqrt(k * EMBED), (k * EMBED, FILTERS))
            self.w[f"bias{k}"] = np.zeros(FILTERS)
        self.w = {n: x.astype(np.float32) for n, x in self.w.items()}
        self.w["emb"][0] = 0

    def train(self, data: np.ndarray, label: np.ndarray) -> None:
        """Adam on cross-entropy; classes weigh the same."""
        rng = np.random.default_rng(SEED)
        share = 1 / np.maximum(np.bincount(label, minlength=len(self.langs)), 1)
        chance = share[label] / share[label].sum()
        first = {n: np.zeros_like(x) for n, x in self.w.items()}
        second = {n: np.zeros_like(x) for n, x in self.w.items()}
        for step in range(1, STEPS + 1):
            pick = rng.choice(len(data), BATCH, p=chance)
            grad = self._gradient(data[pick], label[pick])
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for n, g in grad.items():
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                up = first[n] / (1 - 0.9 ** step)
                self.w[n] -= (rate * up / (np.sqrt(second[n] / (1 - 0.99 ** step)) + 1e-7)
                              ).astype(np.float32)
            self.w["emb"][0] = 0

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        b = len(x)
        e = self.w["emb"][x]
        pooled, where, seen = [], [], []
        for k in WIDTHS:
            n = x.shape[1] - k + 1
            view = np.concatenate([e[:, j:j + n] for j in range(k)], axis=2)
            h = view @ self.w[f"conv{k}"] + self.w[f"bias{k}"]
            top = h.argmax(axis=1)
            pooled.append(np.take_along_axis(h, top[:, None], 1)[:, 0])
            where.append(top)
            seen.append(view)
        z = np.concatenate(pooled, axis=1)
        a = np.maximum(z, 0)
        logit = a @ self.w["dense"] + self.w["dense_bias"]
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p
        d[np.arange(b), y] -= 1
        d /= b
        grad = {"dense": a.T @ d, "dense_bias": d.sum(0), "emb": np.zeros_like(self.w["emb"])}
        dz = (d @ self.w["dense"].T) * (z > 0)
        rows = np.arange(b)[:, None]
        for i, k in enumerate(WIDTHS):
            g = dz[:, i * FILTERS:(i + 1) * FILTERS]
            at = where[i]  # only the position of the maximum passes a gradient
            picked = seen[i][rows, at]  # b x FILTERS x k*EMBED
            grad[f"conv{k}"] = np.einsum("bfe,bf->ef", picked, g)
            grad[f"bias{k}"] = g.sum(0)
            de = (g[:, :, None] * self.w[f"conv{k}"].T[None]).reshape(b, FILTERS, k, EMBED)
            for j in range(k):
                np.add.at(grad["emb"], x[rows, at + j], de[:, :, j])
        grad["emb"][0] = 0
        return grad

    def tables(self) -> dict[int, list[np.ndarray]]:
        return {k: [self.w["emb"] @ self.w[f"conv{k}"][j * EMBED:(j + 1) * EMBED]
                    for j in range(k)] for k in WIDTHS}

    def logits(self, data: np.ndarray) -> np.ndarray:
        """Logits of each window."""
        tables, out = self.tables(), []
        for at in range(0, len(data), 64):
            x = data[at:at + 64]
            pooled = []
            for k in WIDTHS:
                n = x.shape[1] - k + 1
                h = tables[k][0].take(x[:, :n], axis=0)
                for j in range(1, k):
                    h += tables[k][j].take(x[:, j:j + n], axis=0)
                pooled.append(h.max(axis=1) + self.w[f"bias{k}"])
            a = np.maximum(np.concatenate(pooled, axis=1), 0)
            out.append(a @ self.w["dense"] + self.w["dense_bias"])
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)

    def predict(self, values: list[str]) -> list[tuple[str, float]]:
        """Language and probability of each whole text."""
        raw = [v.encode("utf-8", "replace") if _LETTER.search(v) else b"" for v in values]
        data, doc, length = windows(raw)
        total = np.zeros((len(raw), len(self.langs)))
        np.add.at(total, doc, self.logits(data) * length[:, None].astype(np.float64))
        size = np.array([len(r) for r in raw])
        mean = total / np.maximum(size, 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True)) if len(raw) else mean
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [(self.langs[b], float(p[i, b])) if size[i] else (UNKNOWN, 0.0)
                for i, b in enumerate(best.tolist())]


def train(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> ByteCNN | None:
    """Fit on rows with text and lang (null lang and texts without a letter
    teach nothing); None if there are none. At most ``per_lang`` rows of each
    language, smallest hash of the id and the part first; the part is the bytes of
    WINDOW characters at a place that a hash of the id gives. Rows without id or of
    one id differ by their parts; rows equal in both count once."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)),
                   F.greatest(F.length("text") - WINDOW + 1, F.lit(1))) + 1
    usable = (labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
              .select("lang", "doc_id", F.substring("text", place.cast("int"), F.lit(WINDOW))
                      .alias("part")))
    rows = (thinned(usable, "lang", F.xxhash64("doc_id", "part"), per_lang)
            .select("lang", "_h", "part").distinct()
            .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "part")))
            .where(F.col("n") <= per_lang).collect())
    rows.sort(key=lambda r: (r.lang, r.n))
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None
    net = ByteCNN(langs)
    data = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        raw = r.part.encode()[:WINDOW]
        data[i, :len(raw)] = np.frombuffer(raw, np.uint8)
    net.train(data, np.array([langs.index(r.lang) for r in rows]))
    return net


def predict(docs: DataFrame, net: ByteCNN | None,
            into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds lang_pred and score to the columns of ``docs`` (columns of the
    names in ``into`` are replaced). Texts that are null or have no letter, and all texts
    if there is no net, get 'und' and score 0. Whole texts of any length are
    read; repeated rows stay."""
    names = [c for c in docs.columns if c not in into]
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in chunks(batches, "text", SLICE):
            found = (net.predict(texts(batch)) if net
                     else [(UNKNOWN, 0.0)] * batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=[*names, *into])
    own = docs.select(*names)
    schema = ", ".join(f"`{c}` {t}" for c, t in own.dtypes)
    return own.mapInArrow(run, f"{schema}, `{into[0]}` string, `{into[1]}` double")


def with_letter(docs: DataFrame) -> DataFrame:
    """Rows whose text has a letter: those that a net gives a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE):
            yield batch.filter(pa.array([bool(_LETTER.search(t)) for t in texts(batch)],
                                        pa.bool_()))
    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
