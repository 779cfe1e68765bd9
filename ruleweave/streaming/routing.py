"""Pages to routed history, alike for batches and streams.

Each page is observed and encoded once; its route is a column.  Scored and
blocked pages become history rows, refused ones keep their error, and both tables
of a batch are one commit under the batch's own key: a batch repeated after a
failure replaces itself, and nobody sees half of one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ruleweave.contract import FEATURES
from ruleweave.operators import history, pages, providers
from ruleweave.operators.scoring import score
from ruleweave.session import settle
from ruleweave.sources import commits

_REFUSED = T.StructType().add("id", T.LongType()).add("url", T.StringType()).add("error", T.StringType()).add("created_at", T.TimestampNTZType())


@dataclass(frozen=True)
class Lookups:
    """The static tables a page is held against; all but the suffixes may be missing."""

    suffixes: DataFrame
    as_of: Column
    registrations: DataFrame | None = None
    ranks: DataFrame | None = None
    vectors: DataFrame | None = None


def route(rows: DataFrame, lookups: Lookups) -> DataFrame:
    """Encoded pages with ``route`` and, of scored ones, the nine codes in ``codes``.

    A page is scored with the vector that the trusted provider has for its URL, if
    that is valid, or with its own codes if all are verified; it is refused if its
    URL is, and blocked otherwise.
    """
    analyzed = pages.analyze(rows, lookups.suffixes, lookups.as_of, lookups.registrations, lookups.ranks)
    encoded = pages.encode(analyzed)
    own = F.struct(*[pages.code(name).alias(name) for name in FEATURES])
    if lookups.vectors is None:
        supplied = encoded.withColumn("supplied", F.lit(None).cast(f"struct<{','.join(f'{n}:int' for n in FEATURES)}>"))
    else:
        supplied = providers.with_vectors(encoded, lookups.vectors, "supplied")
    codes = F.coalesce("supplied", F.when(F.col("complete"), own))
    routed = supplied.withColumn("codes", F.when(F.col("url_error").isNull(), codes)).drop("supplied")
    state = F.when(F.col("url_error").isNotNull(), "refused").when(F.col("codes").isNotNull(), "scored").otherwise("blocked")
    return routed.withColumn("route", state)


def commit_routed(
    rows: DataFrame, path: str, key: str, lookups: Lookups, table: DataFrame, created_at: Column
) -> None:
    """Route one batch of pages (``id, url, html``) and commit its history and refused rows under ``key``."""
    routed = settle(route(rows, lookups))  # three tables are taken from it
    ready = routed.where("route = 'scored'").select("id", "parts", "codes.*")
    scored = history.scored_rows(score(ready, table), created_at, _redacted())
    blocked = history.blocked_rows(routed.where("route = 'blocked'"), created_at)
    refused = routed.where("route = 'refused'").select(
        F.col("id").cast("long").alias("id"), _redacted().alias("url"), F.col("url_error").alias("error"), created_at.alias("created_at")
    )
    kept = scored.unionByName(blocked).withColumn("day", F.to_date("created_at"))
    tables = {"rows": kept, "refused": refused.withColumn("day", F.to_date("created_at"))}
    commits.commit(rows.sparkSession, path, key, tables, by="day")


def _redacted() -> Column:
    return history.urls.redact(F.col("parts"))


def route_stream(
    stream: DataFrame, path: str, checkpoint: str, lookups: Lookups, table: DataFrame,
    created_at: Column | None = None, name: str = "pages",
) -> StreamingQuery:
    """Route a stream of pages; each batch is one commit, so a restart writes nothing twice."""
    moment = F.current_timestamp().cast("timestamp_ntz") if created_at is None else created_at

    def write(batch: DataFrame, batch_id: int) -> None:
        commit_routed(batch, path, f"{name}-{batch_id}", lookups, table, moment)

    writer: Callable = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_refused(spark: SparkSession, path: str) -> DataFrame:
    """The refused rows of a routed history; an absent table is empty."""
    schema = T.StructType([*_REFUSED, T.StructField("day", T.DateType())])
    return commits.read(spark, path, "refused", commits.current(spark, path) or [], schema)
