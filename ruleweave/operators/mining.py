"""Class-association rules from one weighted grouping.

Only ``weigh`` touches all the data.  It reduces any input to at most 3**9
rows per training run (one per feature vector, with a count per class), with
map-side partial sums, so neither size nor skew of the input reaches the rest.

Every table carries a ``run`` column.  One job mines any number of training
runs at once: folds, splits or a single model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.contract import CLASS_COUNTS, CLASSES, FEATURES, TARGET
from ruleweave.functions import keys
from ruleweave.functions.items import class_item

COUNTS = tuple(CLASS_COUNTS.values())
MODEL = "model"
BAD_RECORD = "Labelled rows have missing or invalid values; see validate.invalid_values"


@dataclass(frozen=True)
class Mining:
    """Thresholds of a training run."""

    min_support: float = 0.01
    min_confidence: float = 0.5
    min_lift: float = 1.0
    max_len: int | None = None  # items per itemset, class item included

    def __post_init__(self) -> None:
        for name, low, high in (("min_support", 0, 1), ("min_confidence", 0, 1), ("min_lift", 0, None)):
            value = getattr(self, name)
            if value < low or (high is not None and value > high) or (name == "min_support" and not value):
                raise ValueError(f"{name}={value} is out of range")


def record_key() -> Column:
    """Key of a labelled row; an error if a feature or the target is not in the shared domain."""
    known = F.when(F.col(TARGET).isin(*CLASSES), keys.pack())
    return F.coalesce(known, F.raise_error(F.lit(BAD_RECORD)).cast("int"))


def weigh(frame: DataFrame, run: Column | str = MODEL) -> DataFrame:
    """Labelled rows to ``run, key`` and one row count per class.

    A missing value or one outside the shared domain ends the job with an error,
    found in the same pass; no row is left out.
    """
    run = F.lit(run) if isinstance(run, str) else run
    return (
        frame.select(run.cast("string").alias("run"), record_key().alias("key"), F.col(TARGET))
        .groupBy("run", "key")
        .agg(*[F.count_if(F.col(TARGET) == c).alias(name) for c, name in CLASS_COUNTS.items()])
    )


def class_totals(cells: DataFrame) -> DataFrame:
    """One row per run: class counts, number of rows and majority class.

    Ties go to the smallest label.
    """
    phishy, suspicious, legitimate = (F.col(name) for name in COUNTS)
    majority = (
        F.when(phishy >= F.greatest(suspicious, legitimate), -1)
        .when(suspicious >= legitimate, 0)
        .otherwise(1)
    )
    return (
        cells.groupBy("run")
        .agg(*[F.sum(name).alias(name) for name in COUNTS])
        .withColumn("n_samples", phishy + suspicious + legitimate)
        .withColumn("majority_class", majority)
    )


def lattice(cells: DataFrame) -> DataFrame:
    """Counts per class of every feature combination that occurs.

    Blanks all subsets of the first features, sums, then of the rest, and sums
    again: the first sum shrinks the input of the second expansion, and both
    stay below 4**9 rows per run.
    """
    middle = len(FEATURES) // 2 + 1
    for features in (range(0, middle), range(middle, len(FEATURES))):
        masks = F.array(*[F.lit(mask) for mask in keys.keep_masks(features)])
        cells = (
            cells.select("run", "key", *COUNTS, F.explode(masks).alias("keep"))
            .groupBy("run", F.col("key").bitwiseAND(F.col("keep")).alias("key"))
            .agg(*[F.sum(name).alias(name) for name in COUNTS])
        )
    return cells


def _total() -> Column:
    return F.col("phishy") + F.col("suspicious") + F.col("legitimate")


def frequent_itemsets(
    cells: DataFrame, mining: Mining, counted: DataFrame | None = None
) -> DataFrame:
    """Itemsets with enough support: ``run, key, class, n, support``.

    ``class`` is NULL for itemsets without a class item.  ``counted`` is the
    lattice of ``cells`` if the caller already has it.
    """
    totals = class_totals(cells).select("run", "n_samples")
    members = F.array(
        F.struct(F.lit(None).cast("int").alias("class"), _total().alias("n")),
        *[F.struct(F.lit(c).alias("class"), F.col(name).alias("n")) for c, name in CLASS_COUNTS.items()],
    )
    size = keys.length(F.col("key")) + F.col("class").isNotNull().cast("int")
    itemsets = (
        (lattice(cells) if counted is None else counted)
        .select("run", "key", F.inline(members))
        .join(F.broadcast(totals), "run")
        .withColumn("support", F.col("n") / F.col("n_samples"))
        .where((size > 0) & (F.col("support") >= mining.min_support))
    )
    if mining.max_len is not None:
        itemsets = itemsets.where(size <= mining.max_len)
    return itemsets.select("run", "key", "class", "n", "support")


def class_rules(
    cells: DataFrame, mining: Mining, counted: DataFrame | None = None
) -> DataFrame:
    """Rules with a single class consequent, unranked.

    The lattice row of an antecedent already holds its joint counts, so no
    join of itemsets is needed.
    """
    totals = class_totals(cells).select(
        "run", "n_samples", *[F.col(name).alias(f"all_{name}") for name in COUNTS]
    )
    members = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.col(name).alias("joint"),
                F.col(f"all_{name}").alias("class_n"),
            )
            for c, name in CLASS_COUNTS.items()
        ]
    )
    size = keys.length(F.col("key"))
    n = F.col("n_samples")
    antecedents = (lattice(cells) if counted is None else counted).where(F.col("key") != 0)
    if mining.max_len is not None:
        antecedents = antecedents.where(size < mining.max_len)
    return (
        antecedents.join(F.broadcast(totals), "run")
        .select("run", "key", "n_samples", _total().alias("covered"), F.inline(members))
        .withColumn("support", F.col("joint") / n)
        .where(F.col("support") >= mining.min_support)
        .withColumn("confidence", F.col("support") / (F.col("covered") / n))
        .withColumn("lift", F.col("confidence") / (F.col("class_n") / n))
        .where(
            (F.col("confidence") >= mining.min_confidence) & (F.col("lift") >= mining.min_lift)
        )
        .select(
            "run",
            "key",
            keys.antecedent(F.col("key")).alias("antecedent"),
            class_item(F.col("class")).alias("consequent"),
            "support",
            "confidence",
            "lift",
            size.cast("int").alias("antecedent_length"),
            "class",
            (F.col("support") / (F.col("class_n") / n)).alias("relative_support"),
        )
    )


def _submasks(spark: SparkSession) -> DataFrame:
    """All pairs of an item mask and a non-empty proper sub-mask: 3**10 rows at most.

    Ten bits, one per feature plus the class item.  ``keep`` blanks the unused
    slots of a wide key (the class item in slot nine).
    """
    bits = len(FEATURES) + 1
    mask = F.shiftright("id", bits).cast("int")
    sub = F.col("id").bitwiseAND((1 << bits) - 1).cast("int")
    keep = sum(
        (F.shiftright(F.col("sub"), i).bitwiseAND(1) * (3 << (2 * i)) for i in range(bits)),
        F.lit(0),
    )
    return (
        spark.range(1 << (2 * bits))
        .select(mask.alias("mask"), sub.alias("sub"))
        .where((F.col("mask").bitwiseAND(F.col("sub")) == F.col("sub")))
        .where((F.col("sub") > 0) & (F.col("sub") < F.col("mask")))
        .select("mask", keep.cast("int").alias("keep"))
    )


def generated_rules(itemsets: DataFrame, thresholds: list[float]) -> DataFrame:
    """Number of rules with any consequent per run and confidence threshold.

    Each frequent itemset meets the support of every proper sub-itemset in an
    equi join; sub-itemsets of a frequent itemset are themselves frequent.
    """
    bits = len(FEATURES) + 1
    wide = F.col("key").bitwiseOR(
        F.shiftleft(F.coalesce(F.col("class") + 2, F.lit(0)), 2 * len(FEATURES))
    )
    mask = sum(
        (
            F.when(F.shiftright(F.col("itemset"), 2 * i).bitwiseAND(3) > 0, 1 << i).otherwise(0)
            for i in range(bits)
        ),
        F.lit(0),
    )
    frequent = itemsets.select("run", wide.alias("itemset"), "support")
    pairs = (
        frequent.withColumn("mask", mask)
        .join(F.broadcast(_submasks(itemsets.sparkSession)), "mask")
        .select(
            "run",
            F.col("support").alias("joint"),
            F.col("itemset").bitwiseAND(F.col("keep")).alias("itemset"),
        )
    )
    confidence = F.col("joint") / F.col("support")
    counts = pairs.join(frequent, ["run", "itemset"]).groupBy("run").agg(
        *[F.count_if(confidence >= t).alias(f"t{i}") for i, t in enumerate(thresholds)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(t).alias("min_confidence"), F.col(f"t{i}").alias("generated_rules"))
            for i, t in enumerate(thresholds)
        ]
    )
    return counts.select("run", F.inline(entries))
