"""Sharding by fixed virtual slots (DataFrame functions only).

Every record is hashed into one of ``n_slots`` virtual slots. Bytes and rows
are summed per slot (at most ``n_slots * CELLS`` groups, whatever the input),
and a versioned slot-to-shard map is stored; only this map is edited when
shards are added or loads drift. The map is control data of fixed size, so
the driver edits it; records never pass through it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

N_SLOTS = 4096
#: Parts of a slot, each numbered by one small window.
CELLS = 16
OVERHEAD = 16


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, cell of every row.

    size: UTF-8 bytes of the text plus 16. A null text has no bytes and the
    crc32 of ''. The slot hash takes id and text, so null or repeated ids do
    not meet in one slot; equal rows do. Other columns are ignored.
    """
    h = F.xxhash64(F.col("doc_id"), F.col("text"))
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("text_crc32"),
        F.pmod(h, F.lit(n_slots)).cast("int").alias("vslot"),
        F.pmod(F.shiftrightunsigned(h, 40), F.lit(CELLS)).cast("int").alias("cell"),
    )


def slot_loads(rec: DataFrame) -> DataFrame:
    """Bytes and rows of every (vslot, cell); partial sums before the shuffle."""
    return rec.groupBy("vslot", "cell").agg(F.sum("size").alias("bytes"),
                                            F.count(F.lit(1)).alias("rows"))


def first_map(slot_bytes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Shard of each slot: largest slot first, to the shard with fewest bytes
    (then fewest slots, then smallest number)."""
    shard = [0] * n_slots
    heap = [(0, 0, s) for s in range(n_shards)]
    for slot in sorted(range(n_slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
        load, count, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (load + slot_bytes.get(slot, 0), count + 1, s))
    return shard


def rebalanced(shard: list[int], slot_bytes: dict[int, int], n_shards: int,
               tolerance: float = 0.02) -> list[int]:
    """An edited map: slots move from the fullest to the emptiest shard while
    that narrows the gap and it is above ``tolerance`` of the mean. Shards
    from ``max(shard) + 1`` to ``n_shards - 1`` start empty; a slot moves only
    when it must, so most rows stay where they are."""
    shard = list(shard)
    load = [0] * n_shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, s in enumerate(shard):
        load[s] += slot_bytes.get(slot, 0)
        own[s].append((slot_bytes.get(slot, 0), slot))
    mean = sum(load) / n_shards
    for _ in range(len(shard)):
        full = max(range(n_shards), key=lambda s: (load[s], -s))
        low = min(range(n_shards), key=lambda s: (load[s], s))
        gap = load[full] - load[low]
        fits = [x for x in own[full] if 0 < x[0] < gap]
        if gap <= tolerance * mean or not fits:
            break
        best = min(fits, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        own[full].remove(best)
        own[low].append(best)
        load[full] -= best[0]
        load[low] += best[0]
        shard[best[1]] = low
    return shard


class SlotMap:
    """Versioned slot-to-shard map below ``path`` (one folder per version)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, version: int, shard: list[int]) -> None:
        rows = [(version, slot, s) for slot, s in enumerate(shard)]
        (self.spark.createDataFrame(rows, "version int, vslot int, shard int")
         .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version:06d}"))

    def read(self, version: int) -> DataFrame:
        return (self.spark.read.schema("vslot int, shard int")
                .parquet(f"{self.path}/version={version:06d}"))

    def load(self, version: int) -> list[int]:
        """The whole map; its length is the fixed number of slots."""
        return [r.shard for r in self.read(version).orderBy("vslot").collect()]


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS,
          slot_map: SlotMap | None = None, version: int = 1) -> DataFrame:
    """Every row with its shard and its place in the shard.

    Returns doc_id, size, text_crc32, vslot, shard, slot (0, 1, … without gaps
    in each shard, ordered by virtual slot, cell, id). The map is stored as
    ``version`` of ``slot_map``. Law: sizes of shards near equal. An empty
    table gives no rows and a map that deals slots out evenly.

    Numbering never gathers a shard: rows are numbered inside a cell (1 part
    in n_slots * CELLS), and the prefix sums over cells are a table of fixed
    size that is broadcast.
    """
    spark = docs.sparkSession
    slot_map = slot_map or SlotMap(spark, scratch_path(spark, "slot_map"))
    rec = records(docs, n_slots)
    loads = slot_loads(rec).collect()  # n_slots * CELLS rows at most
    slot_bytes: dict[int, int] = {}
    for r in loads:
        slot_bytes[r.vslot] = slot_bytes.get(r.vslot, 0) + r.bytes
    slot_map.store(version, first_map(slot_bytes, n_shards, n_slots))

    place = slot_map.load(version)
    at = [0] * n_shards
    offsets = []
    for r in sorted(loads, key=lambda r: (r.vslot, r.cell)):
        s = place[r.vslot]
        offsets.append((r.vslot, r.cell, s, at[s]))
        at[s] += r.rows
    base = spark.createDataFrame(offsets, "vslot int, cell int, shard int, base long")
    inside = Window.partitionBy("vslot", "cell").orderBy("doc_id", "text_crc32", "size")
    return (rec.withColumn("_n", F.row_number().over(inside))
            .join(F.broadcast(base), ["vslot", "cell"])
            .select("doc_id", "size", "text_crc32", "vslot", "shard",
                    (F.col("base") + F.col("_n") - 1).alias("slot")))
