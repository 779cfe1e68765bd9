"""Training and evaluation jobs.

Each job reads the labelled rows once or twice to group them; all mining,
scoring and evaluation runs on the grouped cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.operators import evaluate, mining, ranking, scoring, split
from ruleweave.operators.mining import Mining
from ruleweave.session import settle


@dataclass
class Model:
    """A fitted run: ranked rules and the one-row totals, both small tables."""

    rules: DataFrame
    totals: DataFrame

    def vector_table(self) -> DataFrame:
        return scoring.vector_table(self.rules, self.totals)


def fit(frame: DataFrame, params: Mining = Mining()) -> Model:
    """Mine and rank the class rules of a labelled table."""
    return fit_cells(settle(mining.weigh(frame)), params)


def fit_cells(cells: DataFrame, params: Mining = Mining()) -> Model:
    return Model(settle(ranking.mine_ranked(cells, params)), mining.class_totals(cells))


def fit_class_relative(cells: DataFrame, **limits) -> Model:
    """Mine the short, class-relative rule list."""
    return Model(
        settle(ranking.class_relative_rules(cells, **limits)), mining.class_totals(cells)
    )


def group_assignment(frame: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Side of every distinct record, from one pass over the rows."""
    return settle(split.assign_groups(mining.weigh(frame), test_size, seed))


def group_sides(frame: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Cells of the exact-record group split, runs ``train`` and ``test``."""
    return settle(split.regroup(group_assignment(frame, test_size, seed), F.col("side")))


def side(cells: DataFrame, name: str, run: str = mining.MODEL) -> DataFrame:
    """One side's cells as a run of its own."""
    return cells.where(F.col("run") == name).withColumn("run", F.lit(run))


def threshold_experiments(
    cells: DataFrame, thresholds: list[float], min_support: float = 0.01, min_lift: float = 1.0
) -> DataFrame:
    """One row per confidence threshold, fitted on ``train`` and scored on ``test``, also if nothing is mined.

    Rules are mined and ranked once at the lowest threshold; a higher one keeps
    a part of them in the same order.
    """
    lowest = Mining(min_support, min(thresholds), min_lift)
    train, test = side(cells, "train"), side(cells, "test")
    limits = F.array(*[F.lit(float(t)) for t in thresholds])

    def per_threshold(frame: DataFrame) -> DataFrame:
        return frame.withColumn("min_confidence", F.explode(limits)).withColumn(
            "run", F.col("min_confidence").cast("string")
        )

    counted = settle(mining.lattice(train))
    frequent = settle(mining.frequent_itemsets(train, lowest, counted))
    rules = settle(
        per_threshold(ranking.mine_ranked(train, lowest, counted))
        .where(F.col("confidence") >= F.col("min_confidence"))
        .drop("min_confidence")
    )
    totals = per_threshold(mining.class_totals(train)).drop("min_confidence")
    table = scoring.vector_table(rules, totals)
    scored = settle(
        scoring.score_cells(per_threshold(test).drop("min_confidence"), table)
    )
    itemsets = frequent.groupBy("run").agg(F.count("*").alias("frequent_itemsets"))
    generated = mining.generated_rules(frequent, [float(t) for t in thresholds])
    counts = generated.join(F.broadcast(itemsets), "run").withColumn("run", F.col("min_confidence").cast("string"))
    kept = rules.groupBy("run").agg(F.count("*").alias("kept_rules"))
    asked = [(float(t),) for t in thresholds]
    base = train.sparkSession.createDataFrame(asked, "min_confidence double").distinct()
    none = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return (
        base.withColumn("run", F.col("min_confidence").cast("string"))
        .join(counts.drop("min_confidence"), "run", "left")
        .join(evaluate.run_metrics(scored), "run", "left")
        .join(kept, "run", "left")
        .select(
            "min_confidence",
            none("frequent_itemsets"),
            none("generated_rules"),
            none("kept_rules"),
            "accuracy",
            "macro_f1",
            F.col("rows_unmatched").alias("unmatched_rows"),
        )
    )


def compare_splits(
    frame: DataFrame, key: str, params: Mining, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Metrics of the same mining under the group split and the row-level split."""
    by_group = group_sides(frame, test_size, seed)
    by_row = settle(split.side_cells(split.row_split(frame, key, test_size, seed)))

    def both(name: str) -> DataFrame:
        return side(by_group, name, "exact_record_groups").unionByName(
            side(by_row, name, "stratified_rows")
        )

    train, test = both("train"), both("test")
    rules = settle(ranking.mine_ranked(train, params))
    totals = mining.class_totals(train)
    scored = settle(scoring.score_cells(test, scoring.vector_table(rules, totals)))
    return evaluate.run_metrics(scored).join(
        totals.select("run", F.col("n_samples").alias("rows_train")), "run"
    )


def fold_cells(folded: DataFrame) -> DataFrame:
    """Cells with one run per fold."""
    return settle(mining.weigh(folded, F.col("fold")))


def cross_validate(cells: DataFrame, folds: int = 5, **limits) -> DataFrame:
    """Class-relative rules fitted on all folds but one and scored on that one.

    All folds are mined in one job, as runs.
    """
    others = F.filter(
        F.sequence(F.lit(0), F.lit(folds - 1)),
        lambda f: f.cast("string") != F.col("run"),
    )
    counts = list(mining.COUNTS)
    fit_on = (
        cells.select(F.explode(others).alias("fold"), "key", *counts)
        .groupBy(F.col("fold").cast("string").alias("run"), "key")
        .agg(*[F.sum(name).alias(name) for name in counts])
    )
    rules = settle(ranking.class_relative_rules(fit_on, **limits))
    totals = mining.class_totals(fit_on)
    scored = settle(scoring.score_cells(cells, scoring.vector_table(rules, totals)))
    return evaluate.run_metrics(scored).join(
        totals.select("run", F.col("n_samples").alias("rows_fit")), "run"
    )


def class_relative_job(frame: DataFrame, key: str, test_size: float = 0.3, seed: int = 42):
    """Stratified rows, class-relative rules and their evaluation on the test rows.

    Returns the model, the cells of both sides and the scored test cells.
    """
    cells = settle(split.side_cells(split.row_split(frame, key, test_size, seed)))
    model = fit_class_relative(side(cells, "train"))
    scored = settle(scoring.score_cells(side(cells, "test"), model.vector_table()))
    return model, cells, scored


def class_distribution(cells: DataFrame) -> DataFrame:
    """Rows per run and class."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("class"), F.col(name).alias("row_count"))
            for c, name in zip((-1, 0, 1), mining.COUNTS)
        ]
    )
    return mining.class_totals(cells).select("run", F.inline(entries))
