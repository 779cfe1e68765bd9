"""Deterministic rule order, rule filters and rule summaries.

Rule tables are bounded by the closed key domain, so a window per run sorts a
bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.functions.items import label_text
from ruleweave.operators.mining import Mining, class_rules

# The limits of the class-relative rule policy.
CLASS_RELATIVE = {
    "min_support": 0.002,
    "min_confidence": 0.5,
    "max_antecedent_length": 4,
    "min_relative_support": 0.05,
    "max_rules_per_class": 50,
    "min_lift": 1.0,
}


def _strength_order() -> list:
    """Longer rules win ties."""
    return [
        F.desc("confidence"),
        F.desc("lift"),
        F.desc("support"),
        F.desc("antecedent_length"),
        F.asc("class"),
        F.asc("antecedent"),
    ]


def _class_relative_order() -> list:
    """Shorter rules win ties; the class decides last."""
    return [
        F.desc("confidence"),
        F.desc("relative_support"),
        F.desc("lift"),
        F.asc("antecedent_length"),
        F.asc("antecedent"),
        F.asc("class"),
    ]


def rank_rules(rules: DataFrame) -> DataFrame:
    """Add ``rank`` (1 is strongest) per run."""
    order = Window.partitionBy("run").orderBy(*_strength_order())
    return rules.withColumn("rank", F.row_number().over(order))


def mine_ranked(
    cells: DataFrame, mining: Mining, counted: DataFrame | None = None
) -> DataFrame:
    """Ranked class rules of every run, without the relative support column."""
    return rank_rules(class_rules(cells, mining, counted).drop("relative_support"))


def class_relative_rules(
    cells: DataFrame,
    min_support: float = CLASS_RELATIVE["min_support"],
    min_confidence: float = CLASS_RELATIVE["min_confidence"],
    max_antecedent_length: int = CLASS_RELATIVE["max_antecedent_length"],
    min_relative_support: float = CLASS_RELATIVE["min_relative_support"],
    max_rules_per_class: int = CLASS_RELATIVE["max_rules_per_class"],
    min_lift: float = CLASS_RELATIVE["min_lift"],
) -> DataFrame:
    """Short rules with enough support inside their class, best N per class, ranked."""
    mining = Mining(min_support, min_confidence, min_lift, max_antecedent_length + 1)
    best = Window.partitionBy("run", "class").orderBy(*_class_relative_order())
    order = Window.partitionBy("run").orderBy(*_class_relative_order())
    return (
        class_rules(cells, mining)
        .where(F.col("relative_support") >= min_relative_support)
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= max_rules_per_class)
        .drop("place")
        .withColumn("rank", F.row_number().over(order))
    )


def filter_rules(
    rules: DataFrame, min_confidence: float = 0.0, min_lift: float = 0.0
) -> DataFrame:
    """Keep rules at or above both limits; ``rank`` keeps their order."""
    return rules.where(
        (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)
    )


def top_rules(rules: DataFrame, n: int = 10) -> DataFrame:
    return rules.where(F.col("rank") <= n)


def public_view(rules: DataFrame) -> DataFrame:
    """The five published fields of a rule, with its rank."""
    return rules.select(
        "rank", "antecedent", "consequent", "support", "confidence", "lift"
    )


def explanation_view(rules: DataFrame) -> DataFrame:
    """The rule fields an explanation shows."""
    return rules.select(
        "rank",
        "antecedent",
        "consequent",
        "class",
        label_text(F.col("class")).alias("class_label"),
        "support",
        "confidence",
        "lift",
        "antecedent_length",
    )


def rule_characteristics(rules: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Count, min, max, mean and upper median of the numeric rule fields per run.

    ``runs`` has the ``run`` column of all runs; those without rules get a count of 0.
    """
    fields = ("support", "confidence", "lift", "antecedent_length")
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.col(name).cast("double").alias("value"))
            for name in fields
        ]
    )
    group = Window.partitionBy("run", "field")
    n = F.count("*").over(group)
    place = F.row_number().over(group.orderBy("value"))
    upper_middle = F.floor(n / 2) + 1
    found = (
        rules.select("run", F.inline(entries))
        .withColumn("median", F.when(place == upper_middle, F.col("value")))
        .groupBy("run", "field")
        .agg(
            F.count("*").alias("rules"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            F.max("median").alias("median"),
        )
    )
    if runs is None:
        return found
    every = runs.select("run").distinct().select("run", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    return every.join(found, ["run", "field"], "left").withColumn("rules", F.coalesce("rules", F.lit(0)))


def rules_per_class(rules: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Number of rules per run and class, zeros kept for classes and, given ``runs``, for runs without rules."""
    if runs is not None:
        rules = runs.select("run").distinct().join(rules.select("run", "class"), "run", "left")
    classes = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (
        rules.groupBy("run")
        .agg(*[F.count_if(F.col("class") == c).alias(str(c)) for c in (-1, 0, 1)])
        .select(
            "run",
            F.posexplode(classes).alias("position", "class"),
            F.array(F.col("-1"), F.col("0"), F.col("1")).alias("counts"),
        )
        .select("run", "class", F.col("counts")[F.col("position")].alias("rules"))
    )
