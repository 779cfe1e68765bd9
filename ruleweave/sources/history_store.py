"""The stored prediction history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ruleweave.contract import HISTORY_SCHEMA, PREDICTED
from ruleweave.sources import commits

_STORED = T.StructType([*HISTORY_SCHEMA, T.StructField("day", T.DateType())])


def append_history(rows: DataFrame, path: str, key: str | None = None) -> None:
    """Append rows as one commit, partitioned by day so date filters prune folders.

    Rows committed under a key replace those committed under it before; without
    one they always add to the history.
    """
    dated = rows.withColumn("day", F.to_date("created_at"))
    commits.commit(rows.sparkSession, path, key or uuid.uuid4().hex, {"rows": dated}, by="day")


def write_batch(rows: DataFrame, path: str, batch_id: int, stream: str = "stream") -> None:
    """Write one numbered batch of a stream, replacing an earlier attempt at it."""
    append_history(rows, path, f"{stream}-{batch_id}")


def complete_history(rows: DataFrame) -> DataFrame:
    """History rows in the current schema; ``day`` is kept if present.

    Columns an older table lacks are added as NULL; a missing state means the
    row was predicted.
    """
    columns = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in HISTORY_SCHEMA
    ]
    day = ["day"] if "day" in rows.columns else []
    return rows.select(*columns, *day).withColumn(
        "prediction_status", F.coalesce("prediction_status", F.lit(PREDICTED))
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The stored history in the current schema; an absent table is empty.

    Batches and streams share one log of commits; a folder without one is a plain
    table of an older version.  The schema is given, not merged from files, so no
    footer is read up front.
    """
    lines = commits.current(spark, path)
    if lines is not None:
        return complete_history(commits.read(spark, path, "rows", lines, _STORED))
    try:
        rows = spark.read.schema(_STORED).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], _STORED)
    return complete_history(rows)
