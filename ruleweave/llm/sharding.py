"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

A group hashes into one of a fixed number of bundles whose expected sizes halve
from level to level, and a group that alone weighs a noticeable part of a shard
is an item of its own.  Differencing then repeatedly takes the two partial
partitions with the largest spread and adds them up oppositely ordered; the many
small bundles leave it fine change.  Its input is bounded by the number of
bundles plus `HEAVY_PARTS`, whatever the size of the table.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.llm.common import landed

SHARDS = 24
#: Bytes that every row weighs besides its text.
ROW_BYTES = 8
#: Bundles of one level, and levels; each level holds half the groups of the one before.
WIDTH, LEVELS = 512, 13
#: A group of at least one part in so many of all bytes is placed by itself.
HEAVY_PARTS = 384
#: Rows of one sorting group when slots are dealt.
SLOT_ROWS = 100_000


def difference(items: list[tuple[int, object]], shards: int) -> list[list]:
    """Names of the items of each shard, by multi-way Karmarkar-Karp differencing.

    A partial partition is a list of (load, chain of names), largest first.  No
    items give empty shards; ties fall by the order of the items.
    """
    heap = []
    for at, (size, name) in enumerate(sorted(items, key=lambda x: -x[0])):
        loads = [(size, (name, None, None))] + [(0, None)] * (shards - 1)
        heap.append((-size, at, loads))
    heapq.heapify(heap)
    at = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # the largest part of one meets the smallest of the other
        both = [(x + y, _join(p, q)) for (x, p), (y, q) in zip(a, reversed(b))]
        both.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], at, both))
        at += 1
    return [_names(chain) for _, chain in heap[0][2]] if heap else [[] for _ in range(shards)]


def _join(p, q):
    return p if q is None else q if p is None else (None, p, q)


def _names(chain) -> list:
    found, stack = [], [chain]
    while stack:
        node = stack.pop()
        if node is not None:
            if node[0] is not None:
                found.append(node[0])
            stack += node[1:]
    return found


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A shard and a gapless slot for every row; equal texts share a shard.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.  A null text
    is a text of no bytes with checksum 0; null texts form one group, apart from
    empty ones.  Repeated rows are rows of their own; other columns are ignored.
    An empty table gives no rows.  A group above a shard's share is still not
    divided, so it alone then sets the largest shard.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.unhex(F.md5("text")), F.lit(b""))
    rows = documents.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        key.alias("key"),
    )
    low, high = F.expr(f"pmod(xxhash64(key), {1 << (LEVELS - 1)})"), F.expr(f"pmod(shiftright(xxhash64(key), {LEVELS}), {WIDTH})")
    rows = rows.withColumn("low", low)
    level = F.when(F.col("low") == 0, LEVELS - 1).otherwise(F.expr("bit_count((low & -low) - 1)"))
    rows = rows.withColumn("bundle", (level * WIDTH + high).cast("int")).drop("low")
    rows = landed(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")

    sizes = {r.bundle: [r.size, r.n] for r in rows.groupBy("bundle").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    total, count = sum(s for s, _ in sizes.values()), sum(n for _, n in sizes.values())
    suspects = [b for b, (s, _) in sizes.items() if s * HEAVY_PARTS >= total]
    heavy = []
    if suspects:
        groups = rows.where(F.col("bundle").isin(suspects)).groupBy("bundle", "key").agg(F.sum("size").alias("size"))
        heavy = groups.where(F.col("size") * HEAVY_PARTS >= total).collect()
    for r in heavy:
        sizes[r.bundle][0] -= r.size
    items = [(s, (b, None)) for b, (s, _) in sorted(sizes.items()) if s] + [(r.size, (r.bundle, bytes(r.key))) for r in heavy]
    placed = [(b, k, n) for n, names in enumerate(difference(items, shards)) for b, k in names]
    plain = spark.createDataFrame([(b, n) for b, k, n in placed if k is None], "bundle int, home int")
    alone = spark.createDataFrame([(k, n) for b, k, n in placed if k is not None], "key binary, own int")
    rows = rows.join(F.broadcast(plain), "bundle", "left").join(F.broadcast(alone), "key", "left")
    rows = rows.withColumn("shard", F.coalesce("own", "home"))

    deals = max(16, -(-count // (shards * SLOT_ROWS)))
    rows = rows.withColumn("deal", F.expr(f"pmod(xxhash64(row), {deals})"))
    before = rows.groupBy("shard", "deal").agg(F.count("*").alias("n"))
    before = before.select("shard", "deal", (F.sum("n").over(W.partitionBy("shard").orderBy("deal")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("shard", "deal").orderBy("doc_id", "row")) - 1
    return rows.withColumn("inside", inside).join(before, ["shard", "deal"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("inside")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
