"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector o near centroid c is kept as the signs of P(o - c) (P: rows of a
random orthogonal matrix on the zero-padded vector), its residual norm and a
correction scalar. <o, q> = <c, q> + |o - c| <r, q> with r the unit residual,
and <r, q> is estimated from the bits as <code, Pq> / <code, Pr>. The error of
this estimate is bounded (with overwhelming probability) by
EPSILON * |q| * sqrt((1 - s^2) / s^2) / sqrt(bits - 1), s = <code, Pr>. Only
vectors whose upper bound reaches the k-th best value known so far are
reranked with the original vectors in double precision.

Only the centroids are fitted on a sample (SAMPLE rows at most, by hash of
the id); every row is indexed. Rows and queries are packed in blocks of fixed
size, and every (query block, row block) is one unit of work keyed by both
numbers, so there is no hot key, however the vectors lie. Each task keeps the
running best k per query and passes on only those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8192
SAMPLE_BYTES = 16 << 20
CENTROIDS = 64
ROWS = 4096  # rows in a block
QUERIES = 4096  # queries in a block
AT_ONCE = 512  # queries estimated in one matrix product
EPSILON = 3.0
SEED = 20240101


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: id and vector not null, no null or non-finite
    component, not zero, and of the most common length (ties: the smaller)."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           v.cast("array<float>").alias("embedding"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull())
            .where(~bad & F.exists(v, lambda x: x != 0)))
    size = (good.groupBy(F.size("embedding").alias("n")).count()
            .orderBy(F.desc("count"), "n").limit(1).collect())
    return good.where(F.size("embedding") == (size[0].n if size else 0))


def rotation(dim: int, bits: int) -> np.ndarray:
    """bits x dim matrix with orthonormal columns."""
    rng = np.random.default_rng(SEED)
    q, r = np.linalg.qr(rng.standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(sample: np.ndarray, k: int = CENTROIDS, rounds: int = 8) -> np.ndarray:
    """k-means of the sample; k at most the rows of the sample."""
    rng = np.random.default_rng(SEED)
    k = min(k, len(sample))
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ c.T - (c * c).sum(1) / 2, axis=1)
        for j in range(k):
            own = sample[near == j]
            if len(own):
                c[j] = own.mean(0)
    return c


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return np.asarray(flat.flatten(), np.float32).reshape(len(column), -1)


def _pack(ids: np.ndarray, v: np.ndarray, centroids: np.ndarray, turn: np.ndarray) -> dict:
    near = np.argmax(v @ centroids.T - (centroids * centroids).sum(1) / 2, axis=1)
    res = (v - centroids[near]).astype(np.float64)
    norm = np.sqrt((res * res).sum(1))
    unit = res / np.where(norm > 0, norm, 1)[:, None]
    turned = unit @ turn.T
    s = np.abs(turned).sum(1) / np.sqrt(turn.shape[0])
    return {"ids": ids.astype("<i8"), "vec": v.astype("<f4"),
            "code": np.packbits(turned > 0, axis=1), "near": near.astype("<i4"),
            "norm": norm.astype("<f4"), "fix": np.where(norm > 0, s, 1).astype("<f4")}


def build_index(good: DataFrame, blocks: int, centroids: np.ndarray,
                turn: np.ndarray) -> DataFrame:
    """One row per block: block, ids, vec, code, near, norm, fix (packed arrays).

    Rows that repeat id and vector fall in the same block and count once.
    """
    names = ("ids", "vec", "code", "near", "norm", "fix")

    def pack(t: pa.Table) -> pa.Table:
        ids, v = t.column("vec_id").to_numpy(), _vectors(t.column("embedding"))
        same = np.concatenate([ids.astype("<i8")[:, None].view("<i4"), v.view("<i4")], axis=1)
        _, own = np.unique(same, axis=0, return_index=True)
        part = _pack(ids[own], v[own], centroids, turn)
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32())}
                        | {n: pa.array([part[n].tobytes()], pa.binary()) for n in names})
    spread = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")
    return (good.withColumn("block", spread).groupBy("block").applyInArrow(
        pack, "block int, " + ", ".join(f"{n} binary" for n in names)))


def pack_queries(queries: DataFrame, blocks: int) -> DataFrame:
    """One row per block: qblock, q_ids, q_vec."""
    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"qblock": pa.array([t.column("qblock")[0].as_py()], pa.int32()),
                         "q_ids": pa.array([t.column("vec_id").to_numpy().astype("<i8").tobytes()],
                                           pa.binary()),
                         "q_vec": pa.array([_vectors(t.column("embedding")).astype("<f4").tobytes()],
                                           pa.binary())})
    return (queries.withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
            .groupBy("qblock").applyInArrow(pack, "qblock int, q_ids binary, q_vec binary"))


class _Best:
    """The k best rows so far of each query of a block."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids = np.concatenate([self.rows[i][0], ids])
        scores = np.concatenate([self.rows[i][1], scores])
        order = np.lexsort((ids, -scores))[:self.k]
        self.rows[i] = (ids[order], scores[order])
        if len(order) == self.k:
            self.least[i] = scores[order[-1]]


def _search(best: _Best, q: np.ndarray, block: dict, centroids: np.ndarray,
            turn: np.ndarray, epsilon: float) -> int:
    """Adds the block's candidates to ``best``; returns how many were reranked."""
    ids = np.frombuffer(block["ids"], "<i8")
    v = np.frombuffer(block["vec"], "<f4").reshape(len(ids), -1).astype(np.float64)
    norm, fix = (np.frombuffer(block[n], "<f4") for n in ("norm", "fix"))
    near = np.frombuffer(block["near"], "<i4")
    bits = turn.shape[0]
    signs = np.unpackbits(np.frombuffer(block["code"], np.uint8).reshape(len(ids), -1),
                          axis=1, count=bits).astype(np.float32) * 2 - 1
    scale = norm / (fix * np.float32(np.sqrt(bits)))
    wide = (epsilon * norm * np.sqrt(np.maximum(1 - fix * fix, 0)) / fix
            / np.sqrt(max(bits - 1, 1))).astype(np.float32)
    k, reranked = best.k, 0
    for at in range(0, len(q), AT_ONCE):
        part = q[at:at + AT_ONCE]
        estimate = (part @ turn.T) @ signs.T * scale + (part @ centroids.T)[:, near]
        slack = np.sqrt((part * part).sum(1))[:, None] * wide
        estimate[best.ids[at:at + AT_ONCE, None] == ids[None, :]] = -np.inf  # its own row
        least = best.least[at:at + len(part)].copy()
        if len(ids) > k:
            low = estimate - slack
            least = np.maximum(least, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
        # single precision of the estimate: a little more room
        keep = estimate + slack * np.float32(1.0001) >= (least - 1e-4 * np.abs(least))[:, None]
        keep &= np.isfinite(estimate)
        for i in np.flatnonzero(keep.any(axis=1)).tolist():
            own = np.flatnonzero(keep[i])
            reranked += len(own)
            best.add(at + i, ids[own], (v[own] * part[i].astype(np.float64)).sum(axis=1))
    return reranked


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, bits_per_dim: int = 4,
            epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` found nearest to
    each of ``queries`` (vec_id, embedding both) by inner product.

    A row with the query's own id is no candidate. Ties go to the smaller
    vec_id; fewer candidates than k are all returned. Unusable vectors (see
    ``usable``) take no part on either side; rows that repeat id and vector
    count once; of several vectors under one query id the smallest array is
    the query. Empty tables give no rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    good = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    schema = "query_id long, rank int, vec_id long, score double"
    n, n_asked = good.count(), asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], schema)
    dim = good.select(F.size("embedding")).first()[0]
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (4 * dim)))
    sample = (good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)
              .select("embedding").collect())
    centroids = fit_centroids(np.array([r.embedding for r in sample], np.float32))
    bits = -(-dim * bits_per_dim // 8) * 8
    turn = rotation(dim, bits)

    blocks, qblocks = -(-n // ROWS), -(-n_asked // QUERIES)
    left = build_index(good, blocks, centroids, turn).withColumn(
        "qblock", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    right = pack_queries(asked, qblocks).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = left.join(right, ["block", "qblock"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = np.frombuffer(row["q_ids"], "<i8")
                q = np.frombuffer(row["q_vec"], "<f4").reshape(len(ids), -1)
                if row["qblock"] not in held and len(held) >= 16:
                    yield from out(held)  # bounded: pass on what is held
                    held = {}
                best = held.setdefault(row["qblock"], _Best(ids, k))
                _search(best, q, row, centroids, turn, epsilon)
        yield from out(held)

    def out(held):
        for best in held.values():
            n = [len(r[0]) for r in best.rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(best.ids, n)),
                 pa.array(np.concatenate([r[0] for r in best.rows]), pa.int64()),
                 pa.array(np.concatenate([r[1] for r in best.rows]), pa.float64())],
                names=["query_id", "vec_id", "score"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.mapInArrow(search, "query_id long, vec_id long, score double")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
