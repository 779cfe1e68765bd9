from __future__ import annotations

import random
import zlib
from collections import defaultdict

from fixtures import awkward, docs_frame

from ruleweave.llm import sharding


def brute(items, shards):
    """Differencing on plain lists."""
    parts = [[(size, [name])] + [(0, [])] * (shards - 1) for size, name in items]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1][0] - p[0][0])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda z: -z[0]))
    return sorted(load for load, _ in parts[0])


def test_differencing_against_lists():
    rng = random.Random(3)
    for shards in (2, 3, 24):
        sizes = rng.sample(range(1, 10**6), 60)
        items = [(s, s) for s in sizes]
        loads = sorted(sum(names) for names in sharding.difference(items, shards))
        assert sum(loads) == sum(sizes)
        assert loads == brute(items, shards)
        assert loads[-1] - loads[0] <= max(sizes)
    assert sharding.difference([], 4) == [[], [], [], []]


def check(rows, out):
    assert len(out) == len(rows)
    slots, homes, loads = defaultdict(list), defaultdict(set), defaultdict(int)
    want = sorted((repr(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in out) == want
    for r in out:
        slots[r.shard].append(r.slot)
        homes[r["size"], r.text_crc32].add(r.shard)
        loads[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return homes, loads


def test_shards(spark):
    rows = awkward()
    homes, _ = check(rows, sharding.shard(docs_frame(spark, rows)).collect())
    texts = {(len(t.encode()) + 8, zlib.crc32(t.encode())) for _, t, _ in rows if t}
    assert all(len(homes[t]) == 1 for t in texts)
    assert sharding.shard(docs_frame(spark, [])).count() == 0


def test_balance_with_a_heavy_group(spark):
    rng = random.Random(1)
    rows = [(i, "w" * rng.randint(1, 4000) + str(i), "s") for i in range(3000)]
    rows += [(5000 + i, "copy " * 100, "s") for i in range(300)]
    _, loads = check(rows, sharding.shard(docs_frame(spark, rows)).collect())
    assert max(loads.values()) - min(loads.values()) < 200
