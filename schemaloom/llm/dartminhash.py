"""Near-duplicates by DartMinHash over weighted shingle sets.

A text is the multiset of its 5-word shingles (all its words, if it has
fewer); the similarity is weighted Jaccard, sum of minima over sum of maxima
of the counts, and a link is a similarity of 0.8 or more.

Signature: each unit of weight of an element is a region in which a hashed
Poisson number of darts lands; a dart has a coordinate (one of K) and a rank,
and each coordinate keeps its earliest dart. Two texts agree in a coordinate
with probability equal to their weighted Jaccard similarity. Ranks are thrown
unit by unit, doubling, until no coordinate is empty, so the work is about
the weight plus K log K, not their product.

Join: BANDS keys of ROWS coordinates each (a pair at 0.8 shares none with
probability below 1e-5). Equal texts collapse first, by a 128-bit key of their
words, and get a number each; ids only name the classes. In each bucket every
member is paired with the smallest number (linear in the bucket). A text is first
compared with the one of these that it shares most buckets with; of the other
pairs those follow that the links found do not join. Links are
verified exactly on the whole texts, and their components found. What is left
are buckets whose members are still in several components: there the members
outside the bucket's largest component are compared with all others, block by
block. A block's exact similarities are one matrix product, and it passes on
no more links than join its components. So no bucket emits all its pairs, and
no link between components is lost to the star.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS_AT_ONCE, Words, chunks, mix, saved, texts
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 5
BANDS = 30
K = ROWS * BANDS
TEXTS_AT_ONCE = 1000
BLOCK = 512  # texts on either side of a block of comparisons
COLUMNS = 4096  # units of shingles that one matrix product takes

_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 20)]))
_RANK_BITS = np.uint64(44)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, element, weight of the shingle multisets, ordered by text, element."""
    count = np.diff(w.first)
    hashes, at = w.grams(SHINGLE, salt=SHINGLE)
    doc = w.doc[at]
    for n in range(1, SHINGLE):
        if (count == n).any():
            h, at = w.grams(n, salt=n)
            own = count[w.doc[at]] == n
            hashes, doc = np.concatenate([hashes, h[own]]), np.concatenate([doc, w.doc[at[own]]])
    if not len(doc):
        return doc, hashes, doc
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each of sum(n) items, and its number 0, 1, … inside the row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int,
               k: int = K) -> np.ndarray:
    """texts x k earliest darts (uint64). Weights are positive; a fractional
    one counts darts below it in its last unit. Rows of texts without elements
    are all ones."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full((texts, k), none)
    if not len(doc):
        return sig
    row, unit = _spread(np.ceil(weight).astype(np.int64))
    cell_doc, room = doc[row], (weight[row] - unit)
    cell = mix(element[row] + unit.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    first, width = 0, 1
    while len(cell):
        row, step = _spread(np.full(len(cell), width))
        rank = (first + step).astype(np.uint64)
        place = mix(cell[row] ^ mix(rank + np.uint64(1)))
        n = np.searchsorted(_POISSON, (place >> np.uint64(11)) * 2.0 ** -53, "right")
        dart, number = _spread(n)
        hit = mix(place[dart] + (number + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        own = row[dart]
        if (room < 1).any():
            inside = (mix(hit) >> np.uint64(11)) * 2.0 ** -53 < room[own]
            hit, own, dart = hit[inside], own[inside], dart[inside]
        value = (rank[dart] << _RANK_BITS) | (hit & np.uint64((1 << 44) - 1))
        at = cell_doc[own] * k + ((hit >> _RANK_BITS) % np.uint64(k)).astype(np.int64)
        np.minimum.at(sig.reshape(-1), at, value)
        first, width = first + width, max(1, first + width)
        short = (sig == none).any(axis=1)[cell_doc]
        cell, cell_doc, room = cell[short], cell_doc[short], room[short]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """texts x BANDS keys; the band's number is part of the key."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0xA24BAED4963EE407) + parts[:, :, r])
    return key.view(np.int64)


def text_keys(w: Words, values: list[str]) -> list[np.ndarray]:
    """Both halves of a 128-bit hash of each word sequence; of the raw text if
    it has no word."""
    count = np.diff(w.first)
    _, place = _spread(count)
    keys = []
    for salt in (0x9FB21C651E98DF25, 0xE7037ED1A0B428DB):
        total = np.zeros(len(values), np.uint64)
        np.add.at(total, w.doc, mix(w.hash ^ mix(place.astype(np.uint64) * np.uint64(salt)
                                                 + np.uint64(salt >> 7))))
        keys.append(mix(total + count.astype(np.uint64)).view(np.int64))
    for i in np.flatnonzero(count == 0).tolist():
        keys[0][i], keys[1][i] = np.frombuffer(hashlib.md5(values[i].encode()).digest(), "<i8")
    return keys


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (``text_keys``), bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in chunks(batches, "text", WORDS_AT_ONCE):
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                yield one(whole.slice(at, TEXTS_AT_ONCE))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = texts(batch)
        w = Words(values)
        sig = signatures(*shingles(w), len(values))
        keys, bands = text_keys(w, values), list(band_keys(sig))
        for i in np.flatnonzero(np.diff(w.first) == 0).tolist():
            bands[i] = bands[i][:0]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(keys[0]), pa.array(keys[1]),
             pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "bands"])
    return (docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, k1 long, k2 long, bands array<long>"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns _k1 and _k2 (``text_keys``)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", WORDS_AT_ONCE):
            values = texts(batch)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names),
                 *map(pa.array, text_keys(Words(values), values))], names=[*names, "_k1", "_k2"])
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, _k1 long, _k2 long")


def rows_named(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``chosen`` (id, k1, k2 and others): a
    row of that id (null is one) and text, with the other columns of ``chosen``."""
    # joined and made distinct by the same columns: texts are shuffled once
    def named(of: DataFrame, key: Column) -> DataFrame:
        return (of.withColumn("_bare", key.isNull())
                .withColumn("_id", F.coalesce(key, F.lit(0).cast("long"))))
    keys = ["_bare", "_id", "_k1", "_k2"]
    wanted = named(chosen.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), F.col("id")).drop("id")
    return (named(keyed(docs), F.col("doc_id").cast("long")).join(wanted, keys)
            .dropDuplicates(keys).drop(*keys))


def similarity(left: list[str], right: list[str]) -> np.ndarray:
    """Exact weighted Jaccard similarity of the texts pair by pair."""
    sides = [shingles(Words(values)) for values in (left, right)]
    totals = [np.bincount(d, c, minlength=len(left)) for d, _, c in sides]
    doc, h, c = (np.concatenate([s[i] for s in sides]) for i in range(3))
    order = np.lexsort((h, doc))
    doc, h, c = doc[order], h[order], c[order]
    both = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
    common = np.bincount(doc[both], np.minimum(c[both], c[both + 1]), minlength=len(left))
    union = totals[0] + totals[1] - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def verified(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (a, b) of numbers whose whole texts (``named``: node, text)
    have the similarity, with it."""
    full = (pairs.join(named.select(F.col("node").alias("a"), "text"), "a")
            .join(named.select(F.col("node").alias("b"), F.col("text").alias("other")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", WORDS_AT_ONCE // 2):
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                sim = similarity(texts(part), texts(part, "other"))
                own = pa.array(sim >= SIMILARITY)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(own), part.column("b").filter(own),
                     pa.array(sim).filter(own)], names=["a", "b", "similarity"])
    return full.select("a", "b", "text", "other").mapInArrow(run, "a long, b long, "
                                                                  "similarity double")


def common_weight(doc: np.ndarray, element: np.ndarray, weight: np.ndarray,
                  left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum of minima of the weights of each (left, right) pair of texts.

    A count of c is c units, so the sum of minima is a product of 0/1 rows.
    """
    row, unit = _spread(weight)
    key = mix(element[row] + unit.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    _, column, n = np.unique(key, return_inverse=True, return_counts=True)
    own = n[column] > 1  # units of one text alone are common to none
    number = np.cumsum(n > 1) - 1
    doc, column = doc[row][own], number[column[own]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    texts = int(max(left.max(), right.max())) + 1
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((texts, COLUMNS), np.float32)
        part[doc[i:j], column[i:j] - at] = 1
        out += part[left] @ part[right].T
    return out


def block_links(ids: list[int], comp: list[int], values: list[str], left: np.ndarray,
                right: np.ndarray) -> list[tuple[int, int]]:
    """Links between texts of different components, as many as join them."""
    doc, element, weight = shingles(Words(values))
    total = np.bincount(doc, weight, minlength=len(values))
    common = common_weight(doc, element, weight, left, right)
    union = total[left][:, None] + total[right][None, :] - common
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x
    out = []
    comps = np.array(comp)
    like = (common >= SIMILARITY * union) & (comps[left][:, None] != comps[right][None, :])
    for i, j in zip(*(x.tolist() for x in np.nonzero(like))):
        a, b = int(left[i]), int(right[j])
        x, y = find(comp[a]), find(comp[b])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return out


def across(members: DataFrame, named: DataFrame) -> DataFrame:
    """Links (a, b) between components of a bucket. ``members``: h, id, comp;
    ``named``: node, text.

    Members outside the bucket's most frequent component are dealt into blocks
    0 .. s - 1, the others into blocks from s on; every block pair with one of
    the first kind is a group of its own.
    """
    sizes = saved(members.groupBy("h").agg(F.mode("comp", True).alias("main"),
                                           F.count(F.lit(1)).alias("n"))
                  .select("h", "main", "n"), "dart_sizes")
    tagged = members.join(sizes, "h").withColumn("in_main", F.col("comp") == F.col("main"))
    count = saved(tagged.groupBy("h").agg(
        F.ceil(F.count_if(~F.col("in_main")) / BLOCK).cast("int").alias("s"),
        F.ceil(F.count_if("in_main") / BLOCK).cast("int").alias("m"), F.first("main").alias("main")),
        "dart_blocks")
    rows = members.join(count, "h").withColumn("in_main", F.col("comp") == F.col("main"))
    block = F.when(F.col("in_main"), F.col("s") + F.pmod(F.xxhash64("id"), F.col("m"))).otherwise(
        F.pmod(F.xxhash64("id"), F.col("s"))).cast("int")
    last = F.when(F.col("in_main"), F.col("s")).otherwise(F.col("s") + F.col("m")) - 1
    dealt = (rows.withColumn("p", block).withColumn("q", F.explode(F.sequence(F.lit(0), last)))
             .select("h", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p",
                     "id", "comp")
             .join(named.select(F.col("node").alias("id"), "text"), "id"))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for part in chunks(iter([batch]), "text", WORDS_AT_ONCE)
                for r in part.to_pylist())
        for (_, i, j), group in groupby(rows, key=lambda r: (r["h"], r["i"], r["j"])):
            group = list(group)
            p = np.array([r["p"] for r in group])
            left, right = np.flatnonzero(p == i), np.flatnonzero(p == j)
            if len(left) and len(right):
                found = block_links([r["id"] for r in group], [r["comp"] for r in group],
                                    [r["text"] or "" for r in group], left, right)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()),
                     pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])
    keys = ["h", "i", "j"]
    return (dealt.repartition(n, *keys).sortWithinPartitions(*keys)
            .mapInArrow(compare, "a long, b long").distinct())


def _tree(found: DataFrame) -> DataFrame:
    """Components (id, class_id) as links: one edge per labelled text."""
    return found.select(F.col("class_id").alias("a"), F.col("id").alias("b"))


def text_classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """k1, k2, id, class of every text of ``rows`` (``signed`` rows of
    ``docs``): id is the smallest of its ids, class a number that the texts
    which links connect have in common."""
    same = saved(rows.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "dart_texts")
    # numbers rise with the id: a first text is a better lead than its copies
    same = saved(same.orderBy("id", "k1", "k2")
                 .withColumn("node", F.monotonically_increasing_id()), "dart_nodes")
    keys = same.select(F.col("node").alias("id"), F.explode("bands").alias("h"))
    bucket = Window.partitionBy("h")
    members = saved(keys.withColumn("lead", F.min("id").over(bucket))
                    .withColumn("n", F.count(F.lit(1)).over(bucket)).where(F.col("n") > 1),
                    "dart_members")
    star = saved(members.where(F.col("id") != F.col("lead"))
                 .groupBy(F.col("lead").alias("a"), F.col("id").alias("b"))
                 .agg(F.count(F.lit(1)).alias("shared")), "dart_star")
    needed = same.select("id", "k1", "k2", "node").join(
        members.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    named = saved(rows_named(docs.select("doc_id", "text"), needed).select("node", "text"),
                  "dart_named")
    # every text meets the lead it shares most buckets with; of the other pairs, those that
    # are not joined by then
    nearest = star.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    nearest = saved(nearest.select("a", "b"), "dart_nearest")
    first = saved(components(saved(verified(nearest, named).select("a", "b"), "dart_links")),
                  "dart_joined")
    others = star.select("a", "b").join(nearest, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        others = others.join(first.select(F.col("id").alias(end),
                                          F.col("class_id").alias(f"{end}_class")), end, "left")
    others = saved(others.where(F.coalesce("a_class", "a") != F.coalesce("b_class", "b"))
                   .select("a", "b"), "dart_others")
    more = saved(verified(others, named).select("a", "b"), "dart_links")
    if not more.isEmpty():
        first = saved(components(_tree(first).unionByName(more)), "dart_first")

    # buckets of three or more whose members are in several components
    labelled = saved(members.where(F.col("n") > 2).join(first, "id", "left").select(
        "h", "id", F.coalesce("class_id", "id").alias("comp")), "dart_labelled")
    mixed = saved(labelled.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
                  .where(F.col("x") != F.col("y")).select("h"), "dart_mixed")
    final = first
    if not mixed.isEmpty():
        more = saved(across(labelled.join(mixed, "h"), named), "dart_more")
        if not more.isEmpty():
            final = components(_tree(first).unionByName(more))
    final = final.select(F.col("id").alias("node"), F.col("class_id").alias("class"))
    return saved(same.select("k1", "k2", "id", "node").join(final, "node", "left").select(
        "k1", "k2", "id", F.coalesce("class", "node").alias("class")), "dart_classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of every row: class_id is the smallest doc_id of the
    texts that links connect.

    Texts of equal word sequences (case of A-Z and punctuation aside) are one
    class; texts without a word only if they are equal, null as ''. A row
    without doc_id is compared with none and has class null. Rows that repeat
    an id with other texts are each compared by their own text. An empty table
    gives no rows; other columns are ignored.
    """
    rows = saved(signed(docs), "dart_rows")
    known = rows.where(F.col("doc_id").isNotNull())
    found = text_classes(docs, known)
    names = saved(found.groupBy("class").agg(F.min("id").alias("class_id")), "dart_names")
    out = saved(found.join(names, "class").select("k1", "k2", "class_id"), "dart_ids")
    classes = (known.select("doc_id", "k1", "k2").join(out, ["k1", "k2"])
               .select("doc_id", "class_id"))
    return classes.unionByName(rows.where(F.col("doc_id").isNull())
                               .select("doc_id", F.lit(None).cast("long").alias("class_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per class of texts, of the smallest id. Rows without
    id are compared too and kept only if no row of their class has one."""
    found = text_classes(docs, saved(signed(docs), "dart_rows"))
    first = found.groupBy("class").agg(F.min(F.struct(
        F.col("id").isNull().alias("bare"), "id", "k1", "k2")).alias("row"))
    return rows_named(docs, saved(first.select("row.id", "row.k1", "row.k2"), "dart_kept"))
