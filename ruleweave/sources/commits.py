"""Whole versions of stored tables.

A commit writes its tables into a folder of its own and only then one line into a
log beside them.  Readers follow the log, so they see a version whole or not at
all, and what a writer left behind when it died is never read.  Under one key the
latest commit counts: a repeated batch replaces itself.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

LOG = "_commits"
_LINE = "key string, sequence long, folder string, tables array<string>, facts string"


def commit(spark: SparkSession, path: str, key: str, tables: dict[str, DataFrame], facts: dict | None = None, by: str | None = None) -> None:
    """Write tables, partitioned by a column if ``by`` names one, and then the line that makes them count."""
    sequence = max((r["sequence"] for r in current(spark, path) or ()), default=0) + 1
    folder = f"commit={sequence:08d}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        writer = table.write.partitionBy(by) if by else table.write
        writer.parquet(f"{path}/{name}/{folder}")
    line = spark.createDataFrame([(key, sequence, folder, list(tables), json.dumps(facts or {}))], _LINE)
    line.coalesce(1).write.json(f"{path}/{LOG}/{folder}")


def current(spark: SparkSession, path: str, key: str | None = None) -> list[Row] | None:
    """The latest line of every key, or of one, in the order of commits; None without a log.

    One line for each key reaches the driver.
    """
    try:
        log = spark.read.schema(_LINE).option("recursiveFileLookup", True).json(f"{path}/{LOG}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    if key is not None:
        log = log.where(F.col("key") == key)
    latest = Window.partitionBy("key").orderBy(F.desc("sequence"), F.desc("folder"))
    lines = log.where("folder is not null").withColumn("place", F.row_number().over(latest)).where("place = 1")
    return lines.drop("place").orderBy("sequence", "folder").collect()


def read(spark: SparkSession, path: str, name: str, lines: list[Row], schema: T.StructType) -> DataFrame:
    """One table of several commits, in the given schema; empty if none of them has it."""
    folders = [f"{path}/{name}/{r['folder']}" for r in lines if name in r["tables"]]
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(T.StructType([*schema, T.StructField("commit", T.StringType())]))
    return found.option("basePath", f"{path}/{name}").parquet(*folders).drop("commit")
