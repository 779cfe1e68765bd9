"""Lookup joins whose left side may have hot keys or many rows without a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.session import ROWS_PER_TASK, parts_for

#: Rows of one key that one task takes; a key with more is dealt over as many parts as it needs.
ROWS_PER_PART = 1_000_000
#: Hot keys that are dealt out, and keys the counting sketch follows; a key it misses has fewer than 1 in HOT_KEYS rows.
HOT_KEYS, TRACKED = 1_000, 20_000
#: Parts for rows without a key, which match nothing; the lookup side is not repeated for them.
NULL_PARTS = 4_096


def hot_keys(left: DataFrame, key: str, rows_per_part: int = ROWS_PER_PART) -> list[tuple[object, int]]:
    """Keys with more rows than a task takes, and how many parts each needs, from one sketch of the key column."""
    return measured(left, [key], rows_per_part)[key][0]


#: Hot keys with their parts, and the number of rows.
Measured = tuple[list[tuple[object, int]], int]


def measured(left: DataFrame, keys: list[str], rows_per_part: int = min(ROWS_PER_PART, ROWS_PER_TASK)) -> dict[str, Measured]:
    """The hot keys of each key column and the number of rows, in one pass over these columns."""
    named = left.select(*[F.col(f"`{key}`").alias(f"k{i}") for i, key in enumerate(keys)])
    top = [F.expr(f"approx_top_k(k{i}, {HOT_KEYS}, {TRACKED}) FILTER (WHERE k{i} IS NOT NULL)").alias(f"k{i}") for i in range(len(keys))]
    found = named.agg(*top, F.count("*").alias("n")).first()
    hot = [[(x["item"], -(-x["count"] // rows_per_part)) for x in found[f"k{i}"] or () if x["count"] > rows_per_part] for i in range(len(keys))]
    return {key: (hot[i], found["n"]) for i, key in enumerate(keys)}


def lookup(
    left: DataFrame, right: DataFrame, key: str, rows_per_part: int = ROWS_PER_PART, rows_per_task: int = ROWS_PER_TASK, known: Measured | None = None
) -> DataFrame:
    """Left join of rows to a table with one row per ``key``.

    ``known`` is what `measured` found of the key column; without it, it is measured here.

    Only hot keys are salted, each by its own number of parts, and only their rows
    of the lookup side are repeated.  Rows without a key are dealt out and match
    nothing.  A lookup side small enough for Spark to broadcast makes this a plain
    hash join.  Rows for more tasks than there are cores are dealt over a number of
    partitions that grows with them: packed, wide rows are small, and by their bytes
    Spark would put too many of them together for the memory of a task.
    """
    kind = left.schema[key].dataType
    hot, rows = known or measured(left, [key], min(rows_per_part, rows_per_task))[key]
    others = [F.col(f"`{c}`") for c in left.columns if c != key and _hashable(left, c)]
    deal = lambda parts: F.pmod(F.xxhash64(*others), parts).cast("int")
    parts: Column = F.lit(1)
    if hot:
        spark = left.sparkSession
        table = F.broadcast(spark.createDataFrame(hot, f"_hot_key {kind.simpleString()}, _parts int"))
        left = left.join(table, F.col(f"`{key}`") == F.col("_hot_key"), "left").drop("_hot_key")
        right = right.join(table, F.col(f"`{key}`") == F.col("_hot_key"), "left").drop("_hot_key")
        parts = F.coalesce("_parts", F.lit(1))
    salted = F.when(F.col(f"`{key}`").isNull(), deal(F.lit(NULL_PARTS)))
    if hot:
        salted = salted.when(parts > 1, deal(parts))
    dealt = left.withColumn("_salt", salted.otherwise(0))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)) if hot else F.lit(0))
    dealt, repeated = dealt.drop("_parts"), repeated.drop("_parts")
    spark = left.sparkSession
    tasks = parts_for(spark, rows, rows_per_task)
    if tasks > spark.sparkContext.defaultParallelism:
        dealt, repeated = (side.repartition(tasks, F.col(f"`{key}`"), "_salt") for side in (dealt, repeated))
    return dealt.join(repeated, [key, "_salt"], "left").drop("_salt")


def _hashable(frame: DataFrame, column: str) -> bool:
    """Plain columns are enough to tell rows apart."""
    return frame.schema[column].dataType.typeName() in ("string", "long", "integer", "timestamp")
