"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.session import scratch_table

#: ASCII white space between words: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own setting: shuffle files go once the query that made them has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def landed(frame: DataFrame, name: str) -> DataFrame:
    """Write once into the shared folder and go on from there.

    Cuts lineage, so that lost executors cost no second pass, and lets several
    later steps read one result.  The shuffle files of the step are not needed any
    more and go at its end.
    """
    spark = frame.sparkSession
    path = scratch_table(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        frame.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(frame.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, one at a time; a missing text is empty."""
    for batch in batches:
        for row in zip(*batch.columns):
            yield tuple(value.as_py() for value in row)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches of bounded rows and bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= most or size >= weight:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
