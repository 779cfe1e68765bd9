"""Quality profile and exploratory statistics.

All of it derives from the distinct records and their counts.  For valid
tables that is at most 3**10 rows whatever the input size; exact integer sums
make the statistics independent of row order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.contract import CLASS_COUNTS, FEATURES, RECORD, TARGET
from ruleweave.operators.validate import require_columns
from ruleweave.session import settle

#: Values of a column that the profile writes out as one text.
DOMAIN_VALUES = 1_000


def distinct_records(frame: DataFrame) -> DataFrame:
    """Distinct records (nulls kept) with their row count ``n``."""
    require_columns(frame)
    return settle(frame.groupBy(*RECORD).agg(F.count("*").alias("n")))


def deduplicate(frame: DataFrame) -> DataFrame:
    """Exact-row deduplication of the ten contract columns."""
    require_columns(frame)
    return frame.select(*RECORD).dropDuplicates()


def _by_features(records: DataFrame) -> DataFrame:
    n = F.col("n")
    nulls = reduce(
        lambda a, b: a + b, [F.col(name).isNull().cast("int") for name in RECORD]
    )
    counts = [
        F.sum(F.when(F.col(TARGET) == c, n).otherwise(0)).alias(name)
        for c, name in CLASS_COUNTS.items()
    ]
    return records.groupBy(*FEATURES).agg(
        *counts,
        (F.count_distinct(TARGET) > 1).alias("conflicting"),
        F.sum(n).alias("rows_in"),
        F.count("*").alias("records_in"),
        F.sum(n * nulls).alias("nulls_in"),
    )


def quality_summary(records: DataFrame) -> DataFrame:
    """One row: sizes, duplicates, nulls, target counts, group and conflict counts."""
    return _by_features(records).agg(
        F.sum("rows_in").alias("row_count"),
        F.lit(len(RECORD)).alias("column_count"),
        F.sum("nulls_in").alias("missing_values"),
        F.sum(F.col("rows_in") - F.col("records_in")).alias("duplicate_rows"),
        F.sum("records_in").alias("unique_rows"),
        F.count("*").alias("feature_group_count"),
        F.count_if("conflicting").alias("conflicting_group_count"),
        *[F.sum(name).alias(f"{name}_rows") for name in CLASS_COUNTS.values()],
    )


def conflicting_groups(records: DataFrame) -> DataFrame:
    """Feature vectors with more than one label, with the rows per label."""
    return _by_features(records).where("conflicting").select(
        *FEATURES, *CLASS_COUNTS.values()
    )


def _unpivot(records: DataFrame) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("column_name"), F.col(name).cast("int").alias("value"))
            for name in RECORD
        ]
    )
    return records.select("n", F.inline(entries))


def value_frequencies(records: DataFrame) -> DataFrame:
    """Rows per column and value, with the share in percent (four digits)."""
    all_rows = F.sum("row_count").over(Window.partitionBy("column_name"))
    return (
        _unpivot(records)
        .groupBy("column_name", "value")
        .agg(F.sum("n").alias("row_count"))
        .withColumn("percent", F.round(F.col("row_count") / all_rows * 100, 4))
    )


def quantiles(counts: DataFrame, points: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles by column of counted values (column_name, value, n).

    Values are dealt by range; sums of the ranges before give each value its
    positions, so no column meets in one task.
    """
    dealt = counts.where("value is not null").select("column_name", "value", "n")
    dealt = settle(dealt.repartitionByRange("column_name", "value").withColumn("part", F.spark_partition_id()))
    column = Window.partitionBy("column_name")
    before = column.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("column_name", "part").agg(F.sum("n").alias("rows_in"))  # a row for each column and range
    parts = parts.withColumn("start", F.coalesce(F.sum("rows_in").over(before), F.lit(0))).withColumn("k", F.sum("rows_in").over(column))
    inside = Window.partitionBy("column_name", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(parts.drop("rows_in")), ["column_name", "part"])
    last = F.col("start") + F.sum("n").over(inside)
    wanted = F.array(*[F.struct(F.lit(name).alias("point"), (F.lit(q) * (F.col("k") - 1)).alias("at")) for name, q in points.items()])
    placed = placed.withColumn("last", last).withColumn("first", F.col("last") - F.col("n"))
    held = lambda at: (F.col("first") <= at) & (at < F.col("last"))
    hits = F.filter(wanted, lambda w: held(F.floor(w["at"])) | held(F.ceil(w["at"])))
    found = placed.select("column_name", "value", "first", "last", F.explode(hits).alias("hit"))
    at = F.col("hit.at")
    share = at - F.floor(at)
    weight = F.when(held(F.floor(at)), 1 - share).otherwise(0) + F.when(held(F.ceil(at)) & (share > 0), share).otherwise(0)
    one = found.withColumn("part_of", F.col("value") * weight)
    return one.groupBy("column_name").agg(*[F.sum(F.when(F.col("hit.point") == name, F.col("part_of"))).alias(name) for name in points])


def _domains(counts: DataFrame) -> DataFrame:
    """The values of columns with at most DOMAIN_VALUES of them as one text; others have too many to be codes."""
    few = counts.groupBy("column_name").agg(F.count("*").alias("values")).where(F.col("values") <= DOMAIN_VALUES)
    listed = counts.join(F.broadcast(few), "column_name").groupBy("column_name")  # a row for each column is broadcast
    return listed.agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("domain"))


def column_profile(records: DataFrame) -> DataFrame:
    """Per column: missing values, distinct values, domain and exact statistics, however many values it has.

    The domain text is NULL for a column with more than DOMAIN_VALUES values;
    `value_frequencies` lists them all.
    """
    long = settle(_unpivot(records).groupBy("column_name", "value").agg(F.sum("n").alias("n")))
    value, n = F.col("value"), F.col("n")
    present = F.when(value.isNotNull(), n).otherwise(0)
    sums = long.groupBy("column_name").agg(
        F.sum(n).alias("row_count"),
        F.sum(n - present).alias("missing_count"),
        F.count("*").alias("unique_count"),
        F.sum(present).alias("k"),
        F.sum(value * n).alias("s"),
        F.sum(value.cast("decimal(12,0)") * value.cast("decimal(12,0)") * n).alias("ss"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    k, s, ss = F.col("k"), F.col("s"), F.col("ss")
    # squared sums leave the range of long; beyond 38 digits doubles have to do
    wide, double = (lambda c: c.cast("decimal(38,0)")), (lambda c: c.cast("double"))
    exact = F.try_subtract(F.try_multiply(wide(k), wide(ss)), F.try_multiply(wide(s), wide(s)))
    spread = F.coalesce(double(exact), double(k) * double(ss) - double(s) * double(s))
    variance = F.try_divide(spread, double(k) * double(k - 1))
    points = quantiles(long, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    sums = sums.join(points, "column_name", "left").join(_domains(long), "column_name", "left")
    return sums.select(
        "column_name",
        "row_count",
        "missing_count",
        F.round(F.col("missing_count") / F.col("row_count") * 100, 4).alias("missing_percent"),
        "unique_count",
        "domain",
        k.alias("present_count"),
        F.try_divide(s, k).alias("mean"),
        F.sqrt(variance).alias("std"),
        "min",
        "p25",
        "p50",
        "p75",
        "max",
    )


def correlation_matrix(records: DataFrame) -> DataFrame:
    """Pearson correlation of every column pair, pairwise complete, NULL if constant."""
    pairs = [(a, b) for i, a in enumerate(RECORD) for b in RECORD[i:]]
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair"),
                F.col(a).cast("long").alias("x"),
                F.col(b).cast("long").alias("y"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    x, y, w = F.col("x"), F.col("y"), F.col("n")
    sums = (
        records.select("n", F.inline(entries))
        .where(x.isNotNull() & y.isNotNull())
        .groupBy("pair")
        .agg(
            F.sum(w).cast("double").alias("k"),
            F.sum(w * x).cast("double").alias("sx"),
            F.sum(w * y).cast("double").alias("sy"),
            F.sum(w * x * x).cast("double").alias("sxx"),
            F.sum(w * y * y).cast("double").alias("syy"),
            F.sum(w * x * y).cast("double").alias("sxy"),
        )
    )
    k, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("k", "sx", "sy", "sxx", "syy", "sxy"))
    spread = F.sqrt(k * sxx - sx * sx) * F.sqrt(k * syy - sy * sy)
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    both = sums.withColumn("correlation", F.try_divide(k * sxy - sx * sy, spread)).withColumn(
        "name", names[F.col("pair")]
    )
    a, b = F.col("name")["a"], F.col("name")["b"]
    mirrored = F.filter(
        F.array(
            F.struct(a.alias("column_a"), b.alias("column_b")),
            F.when(a != b, F.struct(b.alias("column_a"), a.alias("column_b"))),
        ),
        lambda e: e.isNotNull(),
    )
    return both.select(F.inline(mirrored), "correlation")
