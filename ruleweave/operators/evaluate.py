"""Evaluation of runs from weighted scored cells.

``scored`` is the output of ``scoring.score_cells``: at most 3**9 rows per run
with the class counts of the evaluated rows and their prediction, so every
measure is one small conditional aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.contract import CLASS_COUNTS, CLASSES, TARGET
from ruleweave.operators.scoring import score
from ruleweave.session import settle

_CODES = {-1: "m1", 0: "z0", 1: "p1"}


def _cell(actual: int, predicted: int) -> str:
    return f"n_{_CODES[actual]}_{_CODES[predicted]}"


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def _confusion_row(scored: DataFrame) -> DataFrame:
    return scored.groupBy("run").agg(
        *[
            F.sum(F.when(F.col("predicted") == p, F.col(name)).otherwise(0)).alias(_cell(a, p))
            for a, name in CLASS_COUNTS.items()
            for p in CLASSES
        ]
    )


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """``run, actual, predicted, row_count`` for all nine pairs, zeros kept."""
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("actual"),
                F.lit(p).alias("predicted"),
                F.col(_cell(a, p)).alias("row_count"),
            )
            for a in CLASSES
            for p in CLASSES
        ]
    )
    return _confusion_row(scored).select("run", F.inline(entries))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per run and class, then macro and weighted
    averages, with the accuracy of the run.  Undefined ratios are 0.
    """
    wide = _confusion_row(scored)
    for c in CLASSES:
        hits = F.col(_cell(c, c))
        wide = wide.withColumn(f"s{_CODES[c]}", _total([F.col(_cell(c, p)) for p in CLASSES]))
        wide = wide.withColumn(
            f"p{_CODES[c]}", _ratio(hits, _total([F.col(_cell(a, c)) for a in CLASSES]))
        )
        wide = wide.withColumn(f"r{_CODES[c]}", _ratio(hits, F.col(f"s{_CODES[c]}")))
        p, r = F.col(f"p{_CODES[c]}"), F.col(f"r{_CODES[c]}")
        wide = wide.withColumn(f"f{_CODES[c]}", _ratio(2 * p * r, p + r))
    columns = {
        kind: [F.col(f"{kind}{_CODES[c]}") for c in CLASSES] for kind in ("p", "r", "f", "s")
    }
    n = _total(columns["s"])
    macro = [_total(columns[kind]) / 3 for kind in ("p", "r", "f")]
    weighted = [
        _ratio(_total([v * s for v, s in zip(columns[kind], columns["s"])]), n)
        for kind in ("p", "r", "f")
    ]
    rows = [
        (str(c), *[F.col(f"{kind}{_CODES[c]}") for kind in ("p", "r", "f", "s")]) for c in CLASSES
    ]
    rows.append(("macro avg", *macro, n))
    rows.append(("weighted avg", *weighted, n))
    entries = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                p.alias("precision"),
                r.alias("recall"),
                f.alias("f1"),
                s.alias("support"),
            )
            for label, p, r, f, s in rows
        ]
    )
    accuracy = _ratio(_total([F.col(_cell(c, c)) for c in CLASSES]), n)
    return wide.select("run", accuracy.alias("accuracy"), F.inline(entries))


def run_metrics(scored: DataFrame) -> DataFrame:
    """One row per run: accuracy, macro and weighted averages, rows and unmatched rows."""
    metrics = class_metrics(scored)
    averages = metrics.groupBy("run").agg(
        F.max("accuracy").alias("accuracy"),
        *[
            F.max(F.when(F.col("label") == f"{kind} avg", F.col(name))).alias(f"{kind}_{name}")
            for kind in ("macro", "weighted")
            for name in ("precision", "recall", "f1")
        ],
    )
    return averages.join(coverage(scored).select("run", "rows_all", "rows_unmatched"), "run")


def coverage(scored: DataFrame) -> DataFrame:
    """One row per run: matched and fallback rows overall, by actual and predicted class."""
    n = _total([F.col(name) for name in CLASS_COUNTS.values()])
    matched = F.col("matching_rule_count") > 0
    hit = F.lit(0)
    for c, name in CLASS_COUNTS.items():
        hit = F.when(F.col("predicted") == c, F.col(name)).otherwise(hit)

    def rows(condition: Column, count: Column) -> Column:
        return F.sum(F.when(condition, count).otherwise(0))

    by_actual = [
        rows(condition, F.col(name)).alias(f"actual_{name}_{state}")
        for name in CLASS_COUNTS.values()
        for state, condition in (("matched", matched), ("unmatched", ~matched))
    ]
    by_predicted = [
        rows(matched & (F.col("predicted") == c), n).alias(f"predicted_{name}_matched")
        for c, name in CLASS_COUNTS.items()
    ]
    return (
        scored.groupBy("run")
        .agg(
            F.sum(n).alias("rows_all"),
            rows(matched, n).alias("rows_matched"),
            rows(~matched, n).alias("rows_unmatched"),
            *by_actual,
            *by_predicted,
            rows(~matched, hit).alias("fallback_correct"),
        )
        .withColumn("rule_coverage", F.try_divide("rows_matched", "rows_all"))
    )


def record_evaluation(frame: DataFrame, table: DataFrame, rules: DataFrame) -> DataFrame:
    """Labelled rows with their outcome and the rule that decided.

    ``table`` and ``rules`` belong to one run; both are bounded by the key domain.
    They are joined first, so that the rows are held against one small table.
    """
    chosen = rules.select(F.col("rank"), F.array_join("antecedent", "|").alias("selected_rule"))
    outcomes = settle(table.join(F.broadcast(chosen), "rank", "left"))
    return (
        score(frame, outcomes)
        .withColumnRenamed(TARGET, "actual")
        .withColumn("matched", F.col("matching_rule_count") > 0)
        .withColumn("default_rule", ~F.col("matched"))
    )


def errors(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.col("actual") != F.col("predicted"))


def select_threshold(experiments: DataFrame) -> DataFrame:
    """The best threshold: macro F1, then accuracy, then the higher threshold."""
    return experiments.orderBy(
        F.desc("macro_f1"), F.desc("accuracy"), F.desc("min_confidence")
    ).limit(1)
