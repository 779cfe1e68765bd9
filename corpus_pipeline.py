"""A corpus pipeline of five stages, each a call of one operator of ``ruleweave.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
result as Parquet into the shared folder and reads it again for the next stage.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import byte_pairs, decontaminate, line_rules, near_copies, repeated_spans
from ruleweave.llm.common import landed, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the frequent lines of their source."""
    return line_rules.clean(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Documents without an id stay unless they stand in a group that has one.
    """
    verdict = near_copies.link(docs).select(F.col("doc_id").alias("_id"), "component_id").distinct()
    gone = verdict.where("component_id is not null and (_id is null or _id != component_id)")
    return docs.join(gone.where("_id is not null").select("_id"), F.col("doc_id") == F.col("_id"), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller id has too."""
    return repeated_spans.remove(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of every document that is left."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_pairs.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("byte-level BPE", tokens),
]
#: Near copies, passages and BPE have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
