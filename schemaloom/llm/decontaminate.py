"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (all its words,
if it has fewer). Windows of m words are found with k-grams, k = (m + 1) // 2
+ 1 at most m: each run of m - k + 1 k-grams keeps its smallest hash (the
first of equal ones), so every shared span of m words or more has a kept
k-gram in common. Fingerprints of documents and benchmark are joined on the
hash; each hit is then extended word by word to both sides, which removes
hash collisions and gives the exact shared span.

Scale: one pass over the documents makes the fingerprints. A bitmap of
2**24 hash prefixes of the benchmark (2 MB, whatever its size) drops nearly
all that cannot match before they leave the task; a saturated bitmap only
drops less. The join is broadcast if the benchmark's fingerprints are few
(counted), else shuffled. What is grouped per document is bounded by its
length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS_AT_ONCE, Words, chunks, saved, texts

WINDOW = 13
BITS = 24
#: Benchmark fingerprints (each about 300 bytes) that are broadcast at most.
BROADCAST_ROWS = 50_000
MIN_SHARE = 20  # contaminated: at least 1 word in so many is hit

_PIECE = "struct<m:int,fp:long,off:int,words:array<string>>"


def gram_of(m: int) -> int:
    """Words in a k-gram for windows of m words."""
    return min(m, (m + 1) // 2 + 1)


def winnowed(w: Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-grams of every text of ``w`` for windows of m words: hash, first word."""
    k = gram_of(m)
    run = m - k + 1
    hashes, at = w.grams(k, salt=m)
    if len(hashes) < run:
        return hashes[:0], at[:0]
    if run > 1:
        low = np.lib.stride_tricks.sliding_window_view(hashes, run).argmin(axis=1)
        low += np.arange(len(low))
        whole = w.doc[at[:len(low)]] == w.doc[at[run - 1:]]
        kept = np.unique(low[whole])
        hashes, at = hashes[kept], at[kept]
    return hashes, at


def _pieces(w: Words, m: int, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, dict]]:
    """(text, piece) per fingerprint; a piece holds the words that windows
    around the k-gram can reach, and the place of the k-gram in them."""
    reach, out = m - gram_of(m), []
    for h, i in zip(hashes.view(np.int64).tolist(), at.tolist()):
        d = int(w.doc[i])
        lo = max(int(w.first[d]), i - reach)
        hi = min(int(w.first[d + 1]), i + gram_of(m) + reach)
        out.append((d, i - int(w.first[d]), {"m": m, "fp": h, "off": i - lo,
                                             "words": [w.word(j) for j in range(lo, hi)]}))
    return out


def benchmark_fingerprints(benchmark: DataFrame) -> DataFrame:
    """m, fp, off, words, ctx, item_id of each kept k-gram of the benchmark.

    ctx names the distinct (m, off, words). Null texts and texts without words
    have none. An item repeated in several rows counts once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", WORDS_AT_ONCE):
            ids, w, out = batch.column("item_id").to_pylist(), Words(texts(batch)), []
            n = np.diff(w.first)
            for m in np.unique(np.minimum(n[n > 0], WINDOW)).tolist():
                hashes, at = winnowed(w, m)
                of = n[w.doc[at]]
                own = (of == m) if m < WINDOW else (of >= m)
                out += [(ids[d], p) for d, _, p in _pieces(w, m, hashes[own], at[own])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in out], pa.string()),
                 *(pa.array([p[c] for _, p in out], t) for c, t in
                   (("m", pa.int32()), ("fp", pa.int64()), ("off", pa.int32()),
                    ("words", pa.list_(pa.string()))))],
                names=["item_id", "m", "fp", "off", "words"])
    rows = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
            .mapInArrow(run, "item_id string, m int, fp long, off int, words array<string>"))
    return rows.withColumn("ctx", F.sha2(F.concat_ws(" ", "m", "off", F.concat_ws(" ", "words")),
                                         256))


def document_pieces(docs: DataFrame, levels: list[int], bitmap: np.ndarray) -> DataFrame:
    """_row, doc_id, n_words and pieces: the fingerprints of each row that the
    bitmap does not exclude."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(np.packbits(bitmap).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(known.value, np.uint8)).view(bool)
        for batch in chunks(batches, "text", WORDS_AT_ONCE):
            w = Words(texts(batch))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for m in levels:
                hashes, at = winnowed(w, m)
                own = bits[(hashes >> np.uint64(64 - BITS)).astype(np.int64)]
                for d, pos, piece in _pieces(w, m, hashes[own], at[own]):
                    found[d].append(piece | {"pos": pos})
            kind = pa.list_(pa.struct([("m", pa.int32()), ("fp", pa.int64()), ("pos", pa.int32()),
                                       ("off", pa.int32()), ("words", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"),
                 pa.array(np.diff(w.first), pa.int64()), pa.array(found, kind)],
                names=["_row", "doc_id", "n_words", "pieces"])
    own = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(run, f"_row long, doc_id {kind}, n_words long, pieces array<struct<"
                               "m:int,fp:long,pos:int,off:int,words:array<string>>>")


def _run_length(equal) -> F.Column:
    """Leading true values of an array of booleans."""
    miss = F.array_position(equal, F.lit(False))
    return F.when(miss > 0, miss - 1).otherwise(F.size(equal)).cast("int")


def _same(a, b) -> F.Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans, n_hit, items, contaminated.

    spans: the shared spans [start, end) in words of the document; n_hit: words
    inside any of them; items: ids (as text, sorted) of the items of which a
    window occurs. Words: runs of 0-9, a-z and non-ASCII characters after A-Z
    are lower-cased. Null and empty texts have no words, no hits and are not
    contaminated; an empty benchmark contaminates nothing. Repeated rows each
    give a row. Extra columns are ignored. contaminated: n_hit > 0 and
    20 * n_hit >= n_words.
    """
    bench = saved(benchmark_fingerprints(benchmark), "bench_fp")
    levels = sorted(r.m for r in bench.select("m").distinct().collect())  # 13 at most
    prefix = F.shiftrightunsigned("fp", 64 - BITS)
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[[r[0] for r in bench.select(prefix).distinct().toLocalIterator()]] = True  # 2**24 at most

    side = (bench.select("m", "fp", F.col("off").alias("b_off"), F.col("words").alias("b_words"),
                         "ctx").distinct())
    items = bench.select("ctx", "item_id").distinct()
    few = bench.count() <= BROADCAST_ROWS
    near = F.broadcast if few else (lambda x: x)

    k = F.least(F.col("m"), F.floor((F.col("m") + 1) / 2) + 1).cast("int")
    rest = lambda words, off: F.slice(words, F.col(off) + 1, F.size(words))
    before = lambda words, off: F.reverse(F.slice(words, F.lit(1), F.col(off)))
    hits = (document_pieces(docs, levels, bitmap)
            .select("_row", "doc_id", "n_words", F.explode_outer("pieces").alias("p"))
            .select("_row", "doc_id", "n_words", "p.*")
            .join(near(side), ["m", "fp"], "left")
            .withColumn("right", _run_length(_same(rest("words", "off"), rest("b_words", "b_off"))))
            .withColumn("left", _run_length(_same(before("words", "off"),
                                                  before("b_words", "b_off"))))
            .withColumn("good", F.col("ctx").isNotNull() & (F.col("right") >= k)
                        & (F.col("left") + F.col("right") >= F.col("m"))))
    span = F.struct((F.col("pos") - F.col("left")).alias("start"),
                    (F.col("pos") + F.col("right")).alias("end"))
    rows = hits.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("good"), span))).alias("spans"),
        F.collect_set(F.when(F.col("good"), F.col("ctx"))).alias("ctxs"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["to"])))
            .alias("n"), F.greatest(acc["to"], s["end"]).alias("to")))["n"].cast("long")
    return (rows.select("_row", "doc_id", "n_words", "spans", covered.alias("n_hit"),
                        F.explode_outer("ctxs").alias("ctx"))
            .join(near(items), "ctx", "left")
            .groupBy("_row").agg(*(F.first(c).alias(c) for c in
                                   ("doc_id", "n_words", "spans", "n_hit")),
                                 F.sort_array(F.collect_set("item_id")).alias("items"))
            .withColumn("contaminated", (F.col("n_hit") > 0)
                        & (MIN_SHARE * F.col("n_hit") >= F.col("n_words")))
            .drop("_row"))
