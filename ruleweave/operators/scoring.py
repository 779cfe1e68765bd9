"""Subset matching of rules and records as equi joins.

A rule matches every vector that fills its unused features in any way.  The
possible fillings are the keys that use exactly the other features, so the
match is an equi join of ``used(rule)`` to the complement of ``used(filling)``
and the vector is the bitwise OR of both.  The outcome for all 3**9 vectors
fits a small table, which makes scoring any input one broadcast equi join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.contract import FEATURES
from ruleweave.functions import keys


def matches(rules: DataFrame) -> DataFrame:
    """All ``run, vector, rank, class, rule`` with the rule matching the vector."""
    fillings = rules.sparkSession.range(keys.KEY_COUNT).select(
        F.col("id").cast("int").alias("filling")
    )
    fillings = fillings.withColumn(
        "rest", F.lit(keys.LOW_BITS).bitwiseXOR(keys.used(F.col("filling")))
    )
    # Rules are bounded by the key domain (and far fewer in practice).
    small = rules.select(
        "run", "rank", "class", F.col("key").alias("rule"), keys.used(F.col("key")).alias("rest")
    )
    return fillings.join(F.broadcast(small), "rest").select(
        "run",
        F.col("rule").bitwiseOR(F.col("filling")).alias("vector"),
        "rank",
        "class",
        "rule",
    )


def all_vectors(totals: DataFrame) -> DataFrame:
    """``run, vector, majority_class`` for every full vector of the shared domain."""
    candidates = F.explode(F.sequence(F.lit(0), F.lit(keys.KEY_COUNT - 1)))
    return totals.select("run", "majority_class", candidates.alias("vector")).where(
        keys.used(F.col("vector")) == keys.LOW_BITS
    )


def vector_table(rules: DataFrame, totals: DataFrame) -> DataFrame:
    """Prediction for every vector and run: 3**9 rows per run at any input size.

    ``totals`` holds the majority class per run.  Columns: ``matching_rule_count``, the winning ``rank`` (NULL if none) and
    ``predicted`` (the majority class if no rule matches).
    """
    winner = F.min(F.col("rank") * 4 + F.col("class") + 2)
    found = (
        matches(rules)
        .groupBy("run", "vector")
        .agg(F.count("*").alias("matching_rule_count"), winner.alias("winner"))
    )
    return (
        all_vectors(totals)
        .join(found, ["run", "vector"], "left")
        .select(
            "run",
            "vector",
            F.coalesce("matching_rule_count", F.lit(0)).cast("long").alias("matching_rule_count"),
            F.shiftright("winner", 2).cast("int").alias("rank"),
            F.coalesce(F.col("winner").bitwiseAND(3) - 2, F.col("majority_class"))
            .cast("int")
            .alias("predicted"),
        )
    )


def score(frame: DataFrame, table: DataFrame) -> DataFrame:
    """Add the outcome of one run's ``vector_table`` to every row.

    Works on batch and streaming rows; rows outside the shared domain get NULLs.
    """
    return (
        frame.withColumn("vector", keys.pack())
        .join(F.broadcast(table.drop("run")), "vector", "left")
        .drop("vector")
    )


def score_cells(cells: DataFrame, table: DataFrame) -> DataFrame:
    """Weighted scoring of grouped rows: one row per run and vector."""
    return cells.withColumnRenamed("key", "vector").join(table, ["run", "vector"])


def matches_by_subset_test(vectors: DataFrame, rules: DataFrame) -> DataFrame:
    """The same matches by testing every pair; the check path for small inputs."""
    pairs = vectors.select("vector").hint("broadcast").join(
        rules.select("run", "rank", "class", F.col("key").alias("rule")),
        F.size(F.array_except(keys.antecedent(F.col("rule")), keys.antecedent(F.col("vector"))))
        == 0,
    )
    return pairs.select("run", "vector", "rank", "class", "rule")


def top_matches(matched: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` strongest matches per vector, with their ``position``."""
    if k < 1:
        raise ValueError("k must be positive")
    order = Window.partitionBy("run", "vector").orderBy("rank")
    return matched.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= k
    )


def feature_evidence(matched: DataFrame) -> DataFrame:
    """Per run, vector and feature: number of matching rules that use the
    feature, and the rank of the strongest one.

    Vectors without any match are absent; ``explain.evidence`` adds them.
    """
    aggregates = []
    for i, _ in enumerate(FEATURES):
        uses = keys.slot(F.col("rule"), i) > 0
        aggregates.append(F.count_if(uses).alias(f"n{i}"))
        aggregates.append(F.min(F.when(uses, F.col("rank"))).alias(f"r{i}"))
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("feature"),
                keys.value(F.col("vector"), i).cast("int").alias("value"),
                F.col(f"n{i}").alias("matching_rule_count"),
                F.col(f"r{i}").cast("int").alias("strongest_rank"),
            )
            for i, name in enumerate(FEATURES)
        ]
    )
    return (
        matched.groupBy("run", "vector")
        .agg(*aggregates)
        .select("run", "vector", F.inline(entries))
    )
