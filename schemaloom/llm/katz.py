"""Katz backoff language model (bigrams) counted, stored and applied in blocks.

P(w) is c(w) discounted by Good-Turing over N; what the discounts free is the
probability of the one unknown word, so P sums to 1 over vocabulary + unknown.
P(w | v) is the discounted c(v, w) / c(v) where (v, w) was seen, else
alpha(v) P(w) with alpha(v) = (1 - sum of the seen) / (1 - sum of P of the
seen), so each context sums to 1 exactly. An unknown context backs off with
alpha 1. The first word's context is a begin mark; the last token is an end.

How it runs at scale. Texts become blocks (BLOCK bytes): token streams over a
block's own vocabulary, written once to the shared folder. A block asks each
shard of the model once per distinct word, and once per distinct word pair, in
packed messages, and gets the counts back the same way: what is shuffled is
pre-aggregated per block, not one row per token or per document and n-gram.
Shards hold contexts by hash; a context with more than 1 / (4 * shards) of all
tokens is dealt out by its second word and its sums are added up afterwards
(4 * shards contexts at most). The number of shards follows the number of
tokens, so a shard's size doesn't grow with the corpus. Answers are tables
partitioned by input part; the task of a block reads only its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import WORDS_AT_ONCE, Words, chunks, mix, open_folder, saved, texts

BLOCK = 12 << 20
SHARD_TOKENS = 1_000_000
KEPT = 5  # counts up to this are discounted
END = np.uint64(0x5851F42D4C957F2D)  # the end token's key
BEGIN = np.uint64(0x14057B7EF767814F)  # the begin mark's key, a context only
_LOW48 = np.uint64((1 << 48) - 1)


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unzip(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _six(a: np.ndarray) -> bytes:
    """Low 48 bits of each value, six bytes each."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


# ---- discounts -------------------------------------------------------------


@dataclass
class Discount:
    """Good-Turing discounts d_1 .. d_k of counts up to k; larger are kept.

    If counts of counts don't allow k, a smaller k is taken; if none does,
    every count is scaled by N / (N + types) (``scale``).
    """

    d: np.ndarray
    scale: float = 1.0

    @classmethod
    def of(cls, n: np.ndarray, total: int, types: int) -> Discount:
        """n[r]: number of types seen r times, r = 0 .. KEPT + 1."""
        n = n.astype(np.float64)
        for k in range(KEPT, 0, -1):
            if (n[1:k + 2] <= 0).any():
                continue
            r = np.arange(1, k + 1)
            a = (k + 1) * n[k + 1] / n[1]
            d = ((r + 1) * n[2:k + 2] / (r * n[1:k + 1]) - a) / (1 - a) if a != 1 else r * 0.0
            if ((d > 0) & (d < 1)).all():
                return cls(np.concatenate([[1.0], d, np.ones(KEPT - k)]))
        return cls(np.ones(KEPT + 1), total / (total + max(types, 1)))

    def counts(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.scale * c * np.where(c <= KEPT, self.d[np.minimum(c, KEPT)], 1.0)


@dataclass
class Unigrams:
    """Totals and discount of words; P of counts."""

    tokens: int
    types: int
    unknown: float
    discount: Discount

    @classmethod
    def of(cls, size: np.ndarray, number: np.ndarray) -> Unigrams:
        """From counts of counts: ``number`` types were seen ``size`` times."""
        tokens, types = int((size * number).sum()), int(number.sum())
        n = np.zeros(KEPT + 2)
        few = size <= KEPT + 1
        n[size[few]] = number[few]
        discount = Discount.of(n, tokens, types)
        seen = (discount.counts(size) * number).sum() / max(tokens, 1)
        return cls(tokens, types, max(1.0 - seen, 0.0) if tokens else 1.0, discount)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discount.counts(c) / max(self.tokens, 1), self.unknown)


# ---- blocks ----------------------------------------------------------------


def blocks(docs: DataFrame, root: str) -> DataFrame:
    """Packed token streams: part, block, tokens, name, n_keys, doc_id[], learn[].

    Each block is a file ``name`` below ``root``: the hashes of its n_keys
    distinct tokens, most frequent first, then a compressed place in them per
    token, each document closed by END. ``docs`` has doc_id, text (null: empty)
    and learn. Attempts write under their own names; rows name the files of
    committed tasks.
    """
    open_folder(root, create=True)
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("tokens", pa.int64()),
                        ("name", pa.string()), ("n_keys", pa.int64()),
                        ("doc_id", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, folder = open_folder(root)
        number = 0
        ids, learn, flat, held = [], [], [], 0

        def packed():
            tokens = np.concatenate(flat)
            keys, where, n = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            name = f"block-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}"
            with files.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(keys[order].astype("<u8").tobytes())
                out.write(_zip(place[where].astype("<u4")))
            return pa.RecordBatch.from_pylist([{
                "part": task.partitionId(), "block": number, "tokens": len(tokens), "name": name,
                "n_keys": len(keys), "doc_id": ids, "learn": learn}], schema=schema)
        for batch in chunks(batches, "text", WORDS_AT_ONCE):
            w = Words(texts(batch), spaces=True)
            flat.append(np.insert(w.hash, w.first[1:], END))
            ids += batch.column("doc_id").cast(pa.int64()).to_pylist()
            learn += batch.column("learn").to_pylist()
            held += len(w.data)
            if held >= BLOCK:
                yield packed()
                number += 1
                ids, learn, flat, held = [], [], [], 0
        if ids:
            yield packed()
    return docs.select("doc_id", "text", "learn").mapInArrow(
        run, "part int, block int, tokens long, name string, n_keys long, doc_id array<long>, "
             "learn array<boolean>")


class _Block:
    """An unpacked block: sorted keys, tokens as places in them, documents."""

    def __init__(self, row: dict, root: str):
        files, folder = open_folder(root)
        with files.open_input_file(f"{folder}/{row['name']}") as file:
            raw = file.read()
        keys = np.frombuffer(raw, "<u8", row["n_keys"])
        order = np.argsort(keys)
        self.keys = keys[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.token = place[_unzip(raw[8 * row["n_keys"]:], "<u4")]
        last = np.flatnonzero(self.token == np.searchsorted(self.keys, END))
        self.first = np.concatenate([[0], last[:-1] + 1])
        self.size = np.diff(np.append(self.first, len(self.token)))
        self.learn = np.repeat(np.array(row["learn"], bool), self.size)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """context, word (places; the begin mark is len(keys)) and learned
        count of the distinct pairs, and the pair of each token."""
        n = len(self.keys)
        code = np.empty(len(self.token), np.int64)
        code[1:] = self.token[:-1]
        code[self.first] = n
        code *= n + 1
        code += self.token
        code, where = np.unique(code, return_inverse=True)
        count = np.bincount(where[self.learn], minlength=len(code)).astype(np.uint32)
        return ((code // (n + 1)).astype(np.int32), (code % (n + 1)).astype(np.int32), count,
                where.astype(np.int32))


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _sent(shard: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Slices of equal (ascending) shard numbers."""
    cut = np.searchsorted(shard, np.arange(shards + 1))
    for s in range(shards):
        if cut[s] < cut[s + 1]:
            yield s, slice(cut[s], cut[s + 1])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


# ---- words -----------------------------------------------------------------


def ask_words(packed: DataFrame, root: str, shards: int) -> DataFrame:
    """shard, part, block, keys, counts: distinct words of each block."""
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("block", pa.int32()),
                        ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _Block(row, root)
            count = np.bincount(b.token[b.learn], minlength=len(b.keys)).astype("<u4")
            yield pa.RecordBatch.from_pylist(
                [{"shard": s, "part": row["part"], "block": row["block"],
                  "keys": b.keys[at].tobytes(), "counts": _zip(count[at])}
                 for s, at in _sent(_shard(b.keys, shards), shards)], schema=schema)
    return packed.mapInArrow(run, "shard int, part int, block int, keys binary, counts binary")


_ANSWER = ("part int, block int, shard int, counts binary, contexts binary, "
           "hot array<struct<v:long,few:array<long>,many:long,p:double>>, "
           "sizes array<long>, numbers array<long>")
_ANSWER_SCHEMA = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary()),
    ("contexts", pa.binary()),
    ("hot", pa.list_(pa.struct([("v", pa.int64()), ("few", pa.list_(pa.int64())),
                                ("many", pa.int64()), ("p", pa.float64())]))),
    ("sizes", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64()))])


def _answer(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist([{n: r.get(n) for n in _ANSWER_SCHEMA.names} for r in rows],
                                schema=_ANSWER_SCHEMA)


def count_words(asked: DataFrame) -> DataFrame:
    """Answers per (block, shard): the words' counts in all learned texts. One
    row with part -1 per shard has its counts of counts."""
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        keys = [np.frombuffer(k, "<u8") for k in t.column("keys").to_pylist()]
        counts = [_unzip(c, "<u4") for c in t.column("counts").to_pylist()]
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts)).astype("<i8")
        out, at = [], 0
        for part, block, k in zip(t.column("part").to_pylist(), t.column("block").to_pylist(),
                                  keys):
            out.append({"part": part, "block": block, "shard": shard,
                        "counts": _zip(total[where[at:at + len(k)]])})
            at += len(k)
        size, number = np.unique(total[total > 0], return_counts=True)
        out.append({"part": -1, "shard": shard, "sizes": size.tolist(),
                    "numbers": number.tolist()})
        return _answer(out)
    return asked.groupBy("shard").applyInArrow(run, _ANSWER)


# ---- pairs -----------------------------------------------------------------


def _answers(root: str, part: int, block: int, *columns: str) -> list[dict]:
    """This block's answers in the order of shards."""
    files, folder = open_folder(root)
    t = pq.read_table(f"{folder}/part={part}", filesystem=files, partitioning=None,
                      columns=["shard", *columns], filters=[("block", "=", block)],
                      use_threads=False)
    return sorted(t.to_pylist(), key=lambda r: r["shard"])


def _word_counts(root: str, row: dict) -> np.ndarray:
    return np.concatenate([_unzip(a["counts"], "<i8")
                           for a in _answers(root, row["part"], row["block"], "counts")])


def _deal(b: _Block, v: np.ndarray, w: np.ndarray, count: np.ndarray, hot_from: float,
          shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard of each pair, whether its context is hot, and the order by shard.

    The begin mark counts as hot: all documents share it.
    """
    shard = _shard(np.append(b.keys, BEGIN), shards)[v]
    hot = np.append(count >= hot_from, True)[v]
    shard[hot] = _shard(mix(b.keys[w[hot]] ^ np.append(b.keys, BEGIN)[v[hot]]), shards)
    return shard, hot, np.argsort(shard, kind="stable")


def ask_pairs(packed: DataFrame, root: str, words: str, shards: int,
              hot_from: float) -> DataFrame:
    """shard, part, block and the distinct pairs of each block: contexts (key,
    pairs, hot) and for each pair the second word's key and count, and the
    pair's learned count in the block."""
    names = ("v", "pairs", "hot", "w", "cw", "counts")
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("block", pa.int32()),
                        *((n, pa.binary()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _Block(row, root)
            known = _word_counts(words, row)
            v, w, count, _ = b.pairs()
            shard, hot, order = _deal(b, v, w, known, hot_from, shards)
            v, w, count, hot, shard = (x[order] for x in (v, w, count, hot, shard))
            vkey = np.append(b.keys, BEGIN)
            held = []
            for s, at in _sent(shard, shards):
                ctx, first, n = np.unique(v[at], return_index=True, return_counts=True)
                held.append({"shard": s, "part": row["part"], "block": row["block"],
                             "v": vkey[ctx].astype("<u8").tobytes(), "pairs": _zip(n.astype("<u4")),
                             "hot": _zip(hot[at][first].astype("u1")), "w": _six(b.keys[w[at]]),
                             "cw": _zip(known[w[at]].astype("<i8")),
                             "counts": _zip(count[at].astype("<u4"))})
            yield pa.RecordBatch.from_pylist(held, schema=schema)
    return packed.mapInArrow(run, "shard int, part int, block int, "
                             + ", ".join(f"{n} binary" for n in names))


def count_pairs(asked: DataFrame, unigrams: Unigrams) -> DataFrame:
    """Answers per (block, shard): counts of the pairs; per context, what its
    seen pairs sum up to: pairs seen 1 .. KEPT times, tokens of the others, sum
    of P of the seen words. Hot contexts' sums stand in the row with part -1,
    with the counts of counts up to KEPT + 1 (at size 0: all seen pairs)."""
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        rows = t.to_pylist()
        v, hot, own = [], [], []
        for r in rows:
            n = _unzip(r["pairs"], "<u4")
            own.append((len(n), int(n.sum())))
            v.append(np.repeat(np.frombuffer(r["v"], "<u8"), n))
            hot.append(np.repeat(_unzip(r["hot"], "u1"), n))
        v, hot = np.concatenate(v), np.concatenate(hot)
        w = np.concatenate([_unsix(r["w"]) for r in rows])
        cw = np.concatenate([_unzip(r["cw"], "<i8") for r in rows])
        c = np.concatenate([_unzip(r["counts"], "<u4") for r in rows])
        order = np.lexsort((w, v))
        new_v = np.concatenate([[True], v[order[1:]] != v[order[:-1]]])
        new = new_v | np.concatenate([[True], w[order[1:]] != w[order[:-1]]])
        first = np.flatnonzero(new)
        total = np.add.reduceat(c[order].astype(np.int64), first)
        context = np.cumsum(new_v)[first] - 1
        n_ctx = int(context[-1]) + 1
        few = np.stack([np.bincount(context[total == r], minlength=n_ctx)
                        for r in range(1, KEPT + 1)], axis=1)
        many = np.bincount(context, np.where(total > KEPT, total, 0), minlength=n_ctx)
        seen = np.bincount(context, np.where(total > 0, unigrams.p(cw[order[first]]), 0),
                           minlength=n_ctx)
        # back to the order in which the blocks asked
        pair_of = np.empty(len(order), np.int64)
        pair_of[order] = np.cumsum(new) - 1
        sums = np.concatenate([few, many[:, None]], axis=1).astype("<u4")
        out, at = [], 0
        for r, (contexts, pairs) in zip(rows, own):
            mine = pair_of[at:at + pairs]
            start = np.concatenate([[0], np.cumsum(_unzip(r["pairs"], "<u4"))[:-1]]).astype(np.int64)
            ctx = context[mine[start]]
            out.append({"part": r["part"], "block": r["block"], "shard": shard,
                        "counts": _zip(total[mine].astype("<i8")),
                        "contexts": _zip(np.frombuffer(sums[ctx].T.tobytes()
                                                       + seen[ctx].astype("<f4").tobytes(), "u1"))})
            at += pairs
        is_hot = np.zeros(n_ctx, bool)
        is_hot[context[pair_of[hot > 0]]] = True
        vkeys = v[order[first]][np.concatenate([[True], context[1:] != context[:-1]])]
        n = np.bincount(total[total <= KEPT + 1], minlength=KEPT + 2)
        out.append({"part": -1, "shard": shard, "sizes": list(range(KEPT + 2)),
                    "numbers": [int((total > 0).sum()), *n[1:].tolist()],
                    "hot": [{"v": int(vkeys[i].astype(np.int64)), "few": few[i].tolist(),
                             "many": int(many[i]), "p": float(seen[i])}
                            for i in np.flatnonzero(is_hot).tolist()]})
        return _answer(out)
    return asked.groupBy("shard").applyInArrow(run, _ANSWER)


def stored(answers: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Write the answers partitioned by part, one file per part (rows of one
    part come from one task); returns the folder and the rows with part -1."""
    spark = answers.sparkSession
    root = scratch_path(spark, name)
    (answers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
     .write.partitionBy("part").parquet(root))
    totals = spark.read.schema(answers.drop("part").schema).parquet(f"{root}/part=-1")
    return root, totals


def scored(packed: DataFrame, root: str, words: str, pairs: str, shards: int, hot_from: float,
           unigrams: Unigrams, bigram: Discount, hot: dict[int, tuple]) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, base_score, score per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("learn", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base_score", pa.float64()),
                        ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _Block(row, root)
            known = _word_counts(words, row)
            v, w, _, where = b.pairs()
            shard, is_hot, order = _deal(b, v, w, known, hot_from, shards)
            answers = _answers(pairs, row["part"], row["block"], "counts", "contexts")
            n = np.empty(len(order), np.int64)
            n[order] = np.concatenate([_unzip(a["counts"], "<i8") for a in answers])
            # what each context sums up to, one entry per (shard, context)
            sums, p = [], []
            for a in answers:
                raw = _unzip(a["contexts"], "u1")
                size = len(raw) // (4 * (KEPT + 2))
                sums.append(raw[:size * 4 * (KEPT + 1)].view("<u4").reshape(KEPT + 1, size).T)
                p.append(raw[size * 4 * (KEPT + 1):].view("<f4"))
            sums, p = np.concatenate(sums).astype(np.float64), np.concatenate(p).astype(np.float64)
            del answers
            new = np.concatenate([[True], (v[order[1:]] != v[order[:-1]])
                                  | (shard[order[1:]] != shard[order[:-1]])])
            first = order[new]
            vkey = np.append(b.keys, BEGIN)
            for i in np.flatnonzero(is_hot[first]).tolist():
                few, many, p[i] = hot[int(vkey[v[first[i]]].astype(np.int64))]
                sums[i] = [*few, many]
            r = np.arange(1, KEPT + 1)
            tokens = sums[:, :KEPT] @ r + sums[:, KEPT]  # after this context
            kept = sums[:, :KEPT] @ bigram.counts(r) + bigram.scale * sums[:, KEPT]
            total = tokens + (kept >= tokens * (1 - 1e-12))  # no discount: one more for the unseen
            total = np.maximum(total, 1)
            alpha = np.where(tokens > 0, (1 - kept / total) / (1 - p), 1.0)
            entry = np.empty(len(order), np.int32)
            entry[order] = np.cumsum(new) - 1
            prob = np.where(n > 0, bigram.counts(n) / total[entry],
                            alpha[entry] * unigrams.p(known[w]))
            del sums, p, entry, v, w, n
            log = np.log10(np.maximum(prob, 1e-300))[where]
            c = known[b.token]
            base = np.log10((c + 0.5) / (unigrams.tokens + 0.5 * (unigrams.types + 1)))
            add = lambda x: np.add.reduceat(x, b.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_id"], pa.int64()), pa.array(row["learn"], pa.bool_()),
                 pa.array(b.size, pa.int64()), pa.array(add((c > 0).astype(np.int64)), pa.int64()),
                 pa.array(add(base)), pa.array(add(log))], schema=schema)
    return packed.mapInArrow(run, "doc_id long, learn boolean, n_tokens long, n_known long, "
                                  "base_score double, score double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score of
    every row of ``docs`` (doc_id, text, learn): the model learns from rows with
    learn = true and scores all.

    score and base_score are log10 probabilities of the text's tokens and the
    end; a null or empty text has the end only. Repeated rows each count and
    each get a row. If nothing is learned, every token is the unknown word: it
    has probability 1 and base log10(0.5 / 0.5) = 0. An empty table gives no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "katz_streams")
    packed = saved(blocks(docs.withColumn("learn", F.coalesce("learn", F.lit(False))), root),
                   "katz_blocks")
    tokens, n = packed.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not tokens:
        return spark.createDataFrame([], "doc_id long, learn boolean, n_tokens long, n_known long, "
                                         "train_tokens long, base_score double, score double")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, -(-tokens // SHARD_TOKENS))
    packed = packed.repartition(min(max(tasks, n // 4), n))  # small rows that name the files

    words, totals = stored(count_words(ask_words(packed, root, shards)), "katz_words")
    # counts of counts: at most sqrt(2 * tokens) distinct sizes
    sizes = (totals.select(F.explode(F.arrays_zip("sizes", "numbers")).alias("x"))
             .groupBy("x.sizes").agg(F.sum("x.numbers").alias("n")).collect())
    unigrams = Unigrams.of(np.array([r.sizes for r in sizes], np.int64),
                           np.array([r.n for r in sizes], np.int64))
    hot_from = max(unigrams.tokens / (4 * shards), 1000)

    pairs, totals = stored(count_pairs(ask_pairs(packed, root, words, shards, hot_from), unigrams),
                           "katz_pairs")
    few = {r.sizes: r.n for r in
           totals.select(F.explode(F.arrays_zip("sizes", "numbers")).alias("x"))
           .groupBy("x.sizes").agg(F.sum("x.numbers").alias("n")).collect()}
    n = np.array([few.get(r, 0) for r in range(KEPT + 2)])
    bigram = Discount.of(n, unigrams.tokens, int(n[0]))
    hot = {r.v: ([r[f"f{i}"] for i in range(KEPT)], r.many, r.p) for r in
           totals.select(F.explode("hot").alias("h")).groupBy(F.col("h.v").alias("v"))
           .agg(*(F.sum(F.col("h.few")[i]).alias(f"f{i}") for i in range(KEPT)),
                F.sum("h.many").alias("many"), F.sum("h.p").alias("p"))
           .collect()}  # 4 * shards contexts at most
    return (scored(packed, root, words, pairs, shards, hot_from, unigrams, bigram, hot)
            .withColumn("train_tokens", F.lit(unigrams.tokens).cast("long")))
