"""Seeded train/test splits and folds that never pass a class through one task.

The order inside a class is that of ``md5(seed|key)``.  Group splits order the
distinct records, a bounded table.  Row splits need an exact position in the
order of all rows of a class: counts per hash prefix are refined until each
wanted position has one exact place (hash, key), and rows are then placed by
comparing them with it, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ruleweave.contract import CLASS_COUNTS, FEATURES, TARGET
from ruleweave.functions import keys
from ruleweave.operators.mining import BAD_RECORD, COUNTS, weigh

#: Hex digits by which hash prefixes grow, all of them, and the rows of a cell that are counted one by one.
DIGITS, HASH_DIGITS, CELL_ROWS = 3, 32, 1_000_000


def seeded_hash(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key))


def seeded_order(frame: DataFrame, key: str, seed: int) -> DataFrame:
    """Global seeded shuffle of rows, where an output order is wanted."""
    return frame.orderBy(seeded_hash(seed, F.col(key).cast("string")), key)


# -- exact-record groups -------------------------------------------------------


def record_groups(cells: DataFrame) -> DataFrame:
    """Distinct labelled records: ``run, key, class, n``."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("class"), F.col(name).alias("n")) for c, name in CLASS_COUNTS.items()]
    )
    return cells.select("run", "key", F.inline(entries)).where(F.col("n") > 0)


def _group_text() -> Column:
    values = [keys.value(F.col("key"), i).cast("string") for i in range(len(FEATURES))]
    return F.concat_ws(",", *values, F.col("class").cast("string"))


def assign_groups(cells: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``run, key, class, n, side`` with whole records on one side.

    Per class, groups no larger than the target are taken in seeded order while
    their running total stays within it; then the one remaining group that
    brings the total nearer to the target, if any, is added.  A group larger
    than the target can thus not push the rest out.
    """
    by_class = Window.partitionBy("run", "class")
    seeded = by_class.orderBy("order_hash", "key")
    n = F.col("n")
    rows = F.sum("n").over(by_class)
    target = F.least(F.greatest(F.lit(1), F.bround(rows * F.lit(test_size))), rows - 1).cast("long")
    groups = (
        record_groups(cells)
        .withColumn("order_hash", seeded_hash(seed, _group_text()))
        .withColumn("groups", F.count("*").over(by_class))
        .withColumn("target", target)
        .withColumn("small", F.when(n <= F.col("target"), n).otherwise(0))
        .withColumn("running", F.sum("small").over(seeded.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("taken", (F.col("small") > 0) & (F.col("running") <= F.col("target")))
        .withColumn(
            "gap",
            F.col("target") - F.sum(F.when(F.col("taken"), n).otherwise(0)).over(by_class),
        )
        .withColumn("miss", F.when(~F.col("taken"), F.abs(F.col("gap") - n)))
        .withColumn("place", F.row_number().over(by_class.orderBy(F.asc_nulls_last("miss"), "order_hash", "key")))
    )
    topped_up = (F.col("place") == 1) & (F.col("miss") < F.col("gap"))
    in_test = (F.col("groups") > 1) & (F.col("taken") | F.coalesce(topped_up, F.lit(False)))
    return groups.select(
        "run", "key", "class", "n", F.when(in_test, "test").otherwise("train").alias("side")
    )


def regroup(groups: DataFrame, run: Column) -> DataFrame:
    """Record groups back to cells of the given run."""
    return (
        groups.select(run.alias("run"), "key", "class", "n")
        .groupBy("run", "key")
        .agg(
            *[
                F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(name)
                for c, name in CLASS_COUNTS.items()
            ]
        )
    )


def group_split(frame: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with their ``side``; no exact record is on both sides.

    A row with a missing or invalid value ends the job with an error.
    """
    return place_rows(frame, assign_groups(weigh(frame), test_size, seed))


def place_rows(frame: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the ``side`` of their record group.

    The assignment of the at most 3**10 distinct records is broadcast, so rows
    are not shuffled and a hot record is no burden.
    """
    sides = groups.select("key", F.col("class").alias(TARGET), "side")
    placed = frame.withColumn("key", keys.pack()).join(F.broadcast(sides), ["key", TARGET], "left").drop("key")
    return placed.withColumn("side", F.coalesce("side", F.raise_error(F.lit(BAD_RECORD)).cast("string")))


def side_cells(frame: DataFrame) -> DataFrame:
    """Rows with a ``side`` to cells with one run per side."""
    return weigh(frame, F.col("side"))


def shared_vectors(cells: DataFrame) -> DataFrame:
    """Feature vectors on both sides: rows per side and label, conflict flag.

    ``cells`` has the runs ``train`` and ``test``.
    """
    per_side = [
        F.sum(F.when(F.col("run") == side, F.col(name)).otherwise(0)).alias(f"{side}_{name}")
        for side in ("train", "test")
        for name in COUNTS
    ]
    labels = sum(
        ((F.col(f"train_{name}") + F.col(f"test_{name}") > 0).cast("int") for name in COUNTS),
        F.lit(0),
    )
    return (
        cells.groupBy("key")
        .agg(F.count_distinct("run").alias("sides"), *per_side)
        .where(F.col("sides") == 2)
        .withColumn("conflicting_labels", labels > 1)
        .drop("sides")
    )


def split_analysis(cells: DataFrame) -> DataFrame:
    """One row: record groups and feature groups in all, per side and shared."""
    has = {
        (side, name): F.col(f"{side}_{name}") > 0 for side in ("train", "test") for name in COUNTS
    }
    vectors = cells.groupBy("key").agg(
        *[
            F.sum(F.when(F.col("run") == side, F.col(name)).otherwise(0)).alias(f"{side}_{name}")
            for side in ("train", "test")
            for name in COUNTS
        ]
    )

    def records(condition) -> Column:
        return F.sum(sum((condition(name).cast("int") for name in COUNTS), F.lit(0))).cast("long")

    def any_of(side: str) -> Column:
        return has[side, "phishy"] | has[side, "suspicious"] | has[side, "legitimate"]

    labels = sum(
        ((has["train", name] | has["test", name]).cast("int") for name in COUNTS), F.lit(0)
    )
    shared = any_of("train") & any_of("test")
    return vectors.agg(
        records(lambda c: has["train", c] | has["test", c]).alias("record_groups_total"),
        records(lambda c: has["train", c]).alias("record_groups_train"),
        records(lambda c: has["test", c]).alias("record_groups_test"),
        records(lambda c: has["train", c] & has["test", c]).alias("shared_records"),
        F.count("*").alias("feature_groups_total"),
        F.count_if(any_of("train")).alias("feature_groups_train"),
        F.count_if(any_of("test")).alias("feature_groups_test"),
        F.count_if(shared).alias("feature_groups_shared"),
        F.count_if(labels > 1).alias("conflicting_groups_total"),
        F.count_if(shared & (labels > 1)).alias("conflicting_groups_shared"),
    )


# -- rows ----------------------------------------------------------------------


@dataclass(frozen=True)
class Limit:
    """A place in the seeded order of a class; rows up to it, and at it if ``closed``, lie before."""

    order_hash: str
    key: str
    closed: bool

    def passed(self) -> Column:
        same = F.col("order_key") > self.key if self.closed else F.col("order_key") >= self.key
        return (F.col("order_hash") > self.order_hash) | (F.col("order_hash") == self.order_hash) & same


def _ordered(frame: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with their class as ``stratum`` and their place in its seeded order.

    Rows without a class form a class of their own; a missing key counts as an empty text.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    hashed = frame.withColumn("order_key", text).withColumn("order_hash", seeded_hash(seed, F.col("order_key")))
    return hashed.withColumn("stratum", F.coalesce(F.col(TARGET).cast("string"), F.lit("")))


def _running(counts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Counts with ``rows_before`` them and ``rows_all`` of their group."""
    group = Window.partitionBy(*by)
    before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("rows_before", F.coalesce(F.sum("rows_in").over(before), F.lit(0))).withColumn(
        "rows_all", F.sum("rows_in").over(group)
    )


def _inside(cuts: list[Row]) -> Column:
    """Rows of the cells that hold a wanted place."""
    names: dict[int, set[str]] = {}
    for c in cuts:
        names.setdefault(len(c["cell"]), set()).add(c["cell"] + c["stratum"])
    cells = [F.concat(F.substring("order_hash", 1, n), "stratum").isin(*sorted(own)) for n, own in names.items()]
    return reduce(Column.__or__, cells)


def order_limits(
    ordered: DataFrame, ranks: Callable[[Column], Column], cell_rows: int = CELL_ROWS, digits: int = DIGITS
) -> dict[str, list[Limit]]:
    """For every class the limits behind as many rows as ``ranks`` names, given its row count.

    A histogram of hash prefixes tells which cell holds a wanted row; cells with
    more than ``cell_rows`` rows are counted again by a longer prefix, and the rows
    of the cells that are left are counted by their whole place.  Nothing but
    counts is shuffled, and what reaches the driver is a row for each limit.  Rows
    of one key stay together, on the side that brings the count nearer to the
    wanted one; with unique keys it is exact.
    """
    spark = ordered.sparkSession
    cell = F.substring("order_hash", 1, digits).alias("cell")
    counted = ordered.groupBy("stratum", cell).agg(F.count("*").alias("rows_in"))
    placed = _running(counted, ["stratum"], ["cell"]).select("*", F.posexplode(ranks(F.col("rows_all"))).alias("at", "rank"))
    left = (F.col("rank") - F.col("rows_before")).alias("left")
    hit = (F.col("rank") > F.col("rows_before")) & (F.col("rank") <= F.col("rows_before") + F.col("rows_in"))
    cuts = placed.where(hit).select("stratum", "at", "cell", left, "rows_in").collect()
    while wide := [c for c in cuts if c["rows_in"] > cell_rows and len(c["cell"]) < HASH_DIGITS]:
        digits = min(HASH_DIGITS, digits + DIGITS)
        counted = ordered.where(_inside(wide)).groupBy("stratum", F.substring("order_hash", 1, digits).alias("place"))
        finer = _within(spark, counted.agg(F.count("*").alias("rows_in")), wide, ["place"])
        found = finer.select("stratum", "at", F.col("place").alias("cell"), left, "rows_in").collect()
        cuts = [c for c in cuts if c not in wide] + found
    if not cuts:
        return {}
    counted = ordered.where(_inside(cuts)).groupBy("stratum", F.col("order_hash").alias("place"), "order_key")
    last = _within(spark, counted.agg(F.count("*").alias("rows_in")), cuts, ["place", "order_key"])
    nearer = F.col("rows_before") + F.col("rows_in") - F.col("rank") <= F.col("rank") - F.col("rows_before")
    limits: dict[str, list[Limit]] = {}
    for r in sorted(last.withColumn("closed", nearer).collect(), key=lambda r: (r["stratum"], r["at"])):
        limits.setdefault(r["stratum"], []).append(Limit(r["place"], r["order_key"], r["closed"]))
    return limits


def _within(spark: SparkSession, counts: DataFrame, cuts: list[Row], order: list[str]) -> DataFrame:
    """The counts that hold the wanted rows of the cells, with ``rank`` counted inside the cell."""
    wanted = spark.createDataFrame(
        [(c["stratum"], c["cell"], c["at"], c["left"]) for c in cuts], "stratum string, cell string, at int, rank long"
    )
    cells = F.broadcast(wanted.select("stratum", "cell").distinct())
    inside = counts.join(cells.withColumnRenamed("stratum", "s"), (F.col("stratum") == F.col("s")) & F.col("place").startswith(F.col("cell")))
    running = _running(inside.drop("s"), ["stratum", "cell"], order)
    hit = (F.col("rank") > F.col("rows_before")) & (F.col("rank") <= F.col("rows_before") + F.col("rows_in"))
    return running.join(F.broadcast(wanted), ["stratum", "cell"]).where(hit)


def _passed(limits: dict[str, list[Limit]]) -> Column:
    """How many limits of its class a row lies behind."""
    found = F.lit(0)
    for stratum, own in limits.items():
        behind = reduce(Column.__add__, [limit.passed().cast("int") for limit in own], F.lit(0))
        found = F.when(F.col("stratum") == stratum, behind).otherwise(found)
    return found


def _wanted(rows_all: Column, test_size: float) -> Column:
    """Test rows of a class."""
    return F.greatest(F.lit(1), F.bround(rows_all * F.lit(test_size))).cast("long")


def _stretches(rows: Column, folds: int) -> list[Column]:
    """Rows that lie in the first 1 .. folds-1 of so many stretches of almost equal length."""
    return [F.floor((rows * i + (folds - 1)) / folds).cast("long") for i in range(1, folds)]


_PLACES = ("order_key", "order_hash", "stratum")


def row_split(frame: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, **cells: int) -> DataFrame:
    """Rows with their ``side``: the first rows per class in seeded order are the test set.

    ``key`` is a unique column.  Rows are placed by comparing them with one limit
    per class, without a shuffle; the limits come from counts (`order_limits`,
    which takes ``cells``).
    """
    ordered = _ordered(frame, key, seed)
    limits = order_limits(ordered, lambda n: F.array(_wanted(n, test_size)), **cells)
    return ordered.withColumn("side", F.when(_passed(limits) == 0, "test").otherwise("train")).drop(*_PLACES)


def stratified_folds(frame: DataFrame, key: str, folds: int = 5, seed: int = 42, **cells: int) -> DataFrame:
    """Rows with a ``fold`` in 0..folds-1: consecutive stretches of the seeded order of each class.

    Sizes differ by one row at most; rows are placed as in `row_split`.
    """
    ordered = _ordered(frame, key, seed)
    if folds < 2:
        return frame.withColumn("fold", F.lit(0))
    limits = order_limits(ordered, lambda n: F.array(*_stretches(n, folds)), **cells)
    return ordered.withColumn("fold", _passed(limits)).drop(*_PLACES)


def training_folds(
    frame: DataFrame, key: str, test_size: float = 0.3, folds: int = 5, seed: int = 42, **cells: int
) -> DataFrame:
    """Folds of the training rows of ``row_split`` with the same seed.

    Both use one order per class, so the rows behind the test rows are cut into
    stretches without splitting first.
    """

    def ranks(n: Column) -> Column:
        test = _wanted(n, test_size)
        return F.array(test, *[test + stretch for stretch in _stretches(n - test, folds)])

    ordered = _ordered(frame, key, seed)
    limits = order_limits(ordered, ranks, **cells)
    # by its first limit alone, as the filter moves below the columns it uses
    training = ordered.where(_passed({stratum: own[:1] for stratum, own in limits.items()}) == 1)
    return training.withColumn("fold", _passed({stratum: own[1:] for stratum, own in limits.items()})).drop(*_PLACES)
