"""Virtual slots: balance, gapless numbers, versions and rebalancing."""
import random
import zlib
from collections import defaultdict

from schemaloom.llm import sharding
from schemaloom.llm.queries import QUERIES


def test_rows_sizes_and_slots(docs_of, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [(1000 + i, "w" * rng.randrange(3000)) for i in range(4000)]
    got = sharding.shard(docs_of(rows)).collect()
    want = sorted(repr((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
                  for i, t in rows)
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in got) == want
    load, slots = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(load) == set(range(40))
    mean = sum(load.values()) / 40  # the one text of 90 kB is a shard's own
    assert sum(abs(x - mean) < 0.05 * mean for x in load.values()) >= 38


def test_query_balance(spark):
    got = QUERIES["op9_sharding"](spark, "/root/testdata/sf0.01").collect()
    load = defaultdict(int)
    for r in got:
        load[r.shard] += r.size
    mean = sum(load.values()) / 40
    assert max(load.values()) - min(load.values()) <= 0.1 * mean


def test_versions_and_rebalancing(spark, tmp_path):
    rng = random.Random(2)
    load = {s: rng.randrange(1, 100) for s in range(512)}
    m = sharding.SlotMap(spark, f"file://{tmp_path}/map")
    one = sharding.first_map(load, 4, 512)
    m.store(1, one)
    two = sharding.rebalanced(m.load(1), load, 5)
    m.store(2, two)
    assert m.load(1) == one and m.load(2) == two
    moved = [(a, b) for a, b in zip(one, two) if a != b]
    assert {b for _, b in moved} == {4} and len(moved) < 512 / 4
    total = [sum(load[s] for s in range(512) if two[s] == k) for k in range(5)]
    assert max(total) - min(total) <= 0.03 * sum(total) / 5


def test_empty(docs_of):
    assert sharding.shard(docs_of([])).collect() == []
