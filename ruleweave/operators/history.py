"""Prediction history: rows, filters and dashboard figures."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.contract import (
    FEATURES,
    LABELS,
    PREDICTED,
    STATUSES,
    UNAVAILABLE,
)
from ruleweave.functions import urls, vectors
from ruleweave.functions.items import label_text
from ruleweave.operators.scoring import score

VECTOR_TEST = "Dataset Feature Vector Test"


# -- rows ------------------------------------------------------------------------


def _row_id(frame: DataFrame) -> Column:
    """The caller's ``id`` if there is one."""
    value = F.col("id") if "id" in frame.columns else F.lit(None)
    return value.cast("long").alias("id")


def scored_rows(scored: DataFrame, created_at: Column, url: Column | None = None) -> DataFrame:
    """History rows of scored vectors (nine features and ``predicted``)."""
    return scored.select(
        _row_id(scored),
        (F.lit(VECTOR_TEST) if url is None else url).alias("url"),
        F.col("predicted").cast("int").alias("prediction"),
        label_text(F.col("predicted")).alias("label"),
        F.to_json(F.struct(*FEATURES)).alias("features"),
        F.lit(PREDICTED).alias("prediction_status"),
        created_at.alias("created_at"),
    )


def blocked_rows(blocked: DataFrame, created_at: Column) -> DataFrame:
    """History rows of pages that could not be encoded; URLs are redacted."""
    safe = urls.redact(F.col("parts"))
    observed = F.to_json(
        F.struct(
            safe.alias("url"),
            F.col("raw_features"),
            "resource_urls",
            "anchor_hrefs",
            "form_actions",
            "popup_credential_fields",
            "page",
            "ssl_state",
            "domain_information",
            "web_traffic",
        )
    )
    return blocked.select(
        _row_id(blocked),
        safe.alias("url"),
        F.lit(None).cast("int").alias("prediction"),
        F.lit(None).cast("string").alias("label"),
        observed.alias("features"),
        F.lit(UNAVAILABLE).alias("prediction_status"),
        created_at.alias("created_at"),
    )


# -- filters -----------------------------------------------------------------------


def parse_filters(args: Mapping[str, str | None]) -> tuple[dict, str | None]:
    """Filter values and the last error found; a wrong date is left out.

    The end date means the last microsecond of that day, which is excluded.
    """

    def text(key: str) -> str:
        return (args.get(key) or "").strip()

    error = None
    filters: dict = {"classification": text("classification"), "status": text("status")}
    for key, time in (("date_from", {}), ("date_to", dict(hour=23, minute=59, second=59, microsecond=999999))):
        filters[key] = None
        if text(key):
            try:
                filters[key] = datetime.strptime(text(key), "%Y-%m-%d").replace(**time)
            except ValueError:
                error = "Dates must use the YYYY-MM-DD format."
    if filters["classification"] and filters["classification"] not in LABELS.values():
        error = "Unsupported classification filter."
    if filters["status"] and filters["status"] not in STATUSES:
        error = "Unsupported prediction status filter."
    return filters, error


def _moment(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def apply_filters(history: DataFrame, filters: Mapping) -> DataFrame:
    """Filtered rows; unknown class and status values are ignored."""
    if filters.get("classification") in LABELS.values():
        history = history.where(F.col("label") == filters["classification"])
    if filters.get("status") in STATUSES:
        history = history.where(F.col("prediction_status") == filters["status"])
    stored = "day" in history.columns  # lets whole day folders be skipped
    if filters.get("date_from"):
        history = history.where(F.col("created_at") >= _moment(filters["date_from"]))
        if stored:
            history = history.where(F.col("day") >= F.lit(filters["date_from"].date()))
    if filters.get("date_to"):
        history = history.where(F.col("created_at") < _moment(filters["date_to"]))
        if stored:
            history = history.where(F.col("day") <= F.lit(filters["date_to"].date()))
    return history


# -- figures -----------------------------------------------------------------------


def overview(history: DataFrame) -> DataFrame:
    """One row: all rows, rows per class and rows per state, in one pass."""
    return history.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("label") == text).alias(text.lower()) for text in LABELS.values()],
        F.count_if(F.col("prediction_status") == PREDICTED).alias("predicted"),
        F.count_if(F.col("prediction_status") == UNAVAILABLE).alias("mapping_unverified"),
    )


def rule_counts(history: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``rule_count``: matching rules of predicted rows with a valid vector, else NULL."""
    checked = vectors.spread_codes(vectors.check_vectors(history))
    scored = score(checked, table.select("run", "vector", "matching_rule_count"))
    counted = F.when(F.col("prediction_status") == PREDICTED, F.col("matching_rule_count"))
    return scored.withColumn("rule_count", counted).drop("matching_rule_count", *FEATURES)


def rule_evidence(counted: DataFrame) -> DataFrame:
    """One row: predictions with and without rules, mean number of rules, predictions counted."""
    n = F.col("rule_count")
    return counted.agg(
        F.count_if(n > 0).alias("predictions_with_rules"),
        F.count_if(n == 0).alias("predictions_without_rules"),
        F.avg(n).alias("average_matching_rules"),
        F.count(n).alias("prediction_count"),
    )


def feature_distribution(counted: DataFrame) -> DataFrame:
    """Rows per feature and code over predicted rows with a valid vector.

    Codes given as text are valid but not counted; zero counts are absent.
    ``observations`` is the number of counted rows of the feature.
    """
    valid = (F.col("prediction_status") == PREDICTED) & F.col("vector_error").isNull()
    values = (
        counted.where(valid)
        .select(F.inline(vectors.counted_codes()))
        .groupBy("feature", "value")
        .agg(F.count("*").alias("row_count"))
    )
    totals = values.groupBy("feature").agg(F.sum("row_count").alias("observations"))
    return values.join(F.broadcast(totals), "feature")


def recent(history: DataFrame, n: int = 20) -> DataFrame:
    """The latest ``n`` rows; equal times go by descending id."""
    return history.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
