"""Labelled tables: reading, item encoding and deduplicated copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.contract import RECORD, TARGET
from ruleweave.functions.items import class_item, feature_items
from ruleweave.operators.quality import deduplicate
from ruleweave.operators.validate import (
    require_columns,
    validate_dataset,
    validate_training,
)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Contract columns of a CSV (with header) or Parquet table, not yet validated.

    CSV columns go by name, in any order, and extra ones are dropped.  Text
    that is no number becomes NaN, which no domain holds, so it is reported as
    invalid rather than missing.
    """
    if path.rstrip("/").endswith(".csv"):
        raw = spark.read.csv(path, header=True)
        require_columns(raw)
        numbers = {
            name: F.when(
                F.col(name).isNotNull(),
                F.coalesce(F.col(name).try_cast("double"), F.lit(float("nan"))),
            )
            for name in RECORD
        }
        return raw.select(*[number.alias(name) for name, number in numbers.items()])
    raw = spark.read.parquet(path)
    require_columns(raw)
    return raw.select(*RECORD)


def load_training(spark: SparkSession, path: str) -> DataFrame:
    """Read and validate a training table; a missing path is an error."""
    return validate_training(read_labelled(spark, path))


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """As ``load_training`` with the per-feature domains."""
    return validate_dataset(read_labelled(spark, path))


def item_table(frame: DataFrame) -> DataFrame:
    """Every row with its values as items, frequency kept."""
    return frame.select(*feature_items(), class_item().alias(TARGET))


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def write_item_table(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Validate a table, write its item encoding as CSV and return it."""
    items = item_table(load_training(spark, source))
    write_csv(items, path)
    return items


def write_deduplicated(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Write a copy without exact duplicate rows and return it."""
    rows = deduplicate(load_training(spark, source))
    write_csv(rows, path)
    return rows
