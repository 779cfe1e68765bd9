"""Checks of labelled tables against the contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.contract import (
    CLASSES,
    DOMAINS,
    FEATURES,
    RECORD,
    SHARED_DOMAIN,
    TARGET,
    ContractError,
)

SHARED = {**{name: SHARED_DOMAIN for name in FEATURES}, TARGET: CLASSES}
STRICT = {**DOMAINS, TARGET: CLASSES}
MESSAGE_VALUES = 20


def missing_columns(frame: DataFrame) -> list[str]:
    return [name for name in RECORD if name not in frame.columns]


def require_columns(frame: DataFrame) -> None:
    missing = missing_columns(frame)
    if missing:
        raise ContractError("Missing required columns: " + ", ".join(missing))


def _invalid(name: str, domain: Sequence[int]) -> Column:
    return F.col(name).isNotNull() & ~F.col(name).isin(*domain)


def domain_summary(frame: DataFrame) -> DataFrame:
    """Per column: nulls, values outside the shared and outside the strict domain.

    One pass with map-side partial counts and no shuffle of rows.
    """
    require_columns(frame)
    counts = []
    for name in RECORD:
        counts.append(F.count_if(F.col(name).isNull()).alias(f"{name}_nulls"))
        counts.append(F.count_if(_invalid(name, SHARED[name])).alias(f"{name}_shared"))
        counts.append(F.count_if(_invalid(name, STRICT[name])).alias(f"{name}_strict"))
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.col(f"{name}_nulls").alias("null_count"),
                F.col(f"{name}_shared").alias("outside_shared"),
                F.col(f"{name}_strict").alias("outside_strict"),
            )
            for name in RECORD
        ]
    )
    return frame.agg(F.count("*").alias("row_count"), *counts).select(
        "row_count", F.inline(entries)
    )


def invalid_values(
    frame: DataFrame, domains: Mapping[str, Sequence[int]] = STRICT
) -> DataFrame:
    """Every value outside its domain: ``column_name, value, row_count``.

    Grouped with partial counts, so any number of distinct bad values and any
    skew among them is fine.
    """
    require_columns(frame)
    entries = F.array(
        *[
            F.when(
                _invalid(name, domains[name]),
                F.struct(
                    F.lit(name).alias("column_name"), F.col(name).cast("double").alias("value")
                ),
            )
            for name in RECORD
        ]
    )
    return (
        frame.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("entry"))
        .groupBy("entry.column_name", "entry.value")
        .agg(F.count("*").alias("row_count"))
    )


def _raise_invalid(frame: DataFrame, name: str, domains: Mapping[str, Sequence[int]]) -> None:
    """An error that names the first bad values and carries all of them as rows in ``invalid``."""
    bad = invalid_values(frame, domains).where(F.col("column_name") == name)
    values = [row["value"] for row in bad.orderBy("value").limit(MESSAGE_VALUES + 1).collect()]
    shown = [int(v) if v == int(v) else v for v in values[:MESSAGE_VALUES] if v == v]
    more = ", ..." if len(values) > MESSAGE_VALUES else ""
    kind = "Target" if name == TARGET else "Feature"
    error = ContractError(
        f"{kind} column {name!r} contains invalid values {shown}{more}; "
        f"expected only {sorted(domains[name])}"
    )
    error.invalid = bad
    raise error


def _check(frame: DataFrame, domains: Mapping[str, Sequence[int]], outside: str) -> DataFrame:
    summary = {row["column_name"]: row for row in domain_summary(frame).collect()}
    for name in RECORD:
        if summary[name]["null_count"]:
            kind = "Target" if name == TARGET else "Feature"
            raise ContractError(f"{kind} column {name!r} contains missing values")
        if summary[name][outside]:
            _raise_invalid(frame, name, domains)
    return frame.select(*[F.col(name).cast("int").alias(name) for name in RECORD])


def validate_training(frame: DataFrame) -> DataFrame:
    """The ten contract columns, duplicates kept, or an error naming the column."""
    return _check(frame, SHARED, "outside_shared")


def validate_dataset(frame: DataFrame) -> DataFrame:
    """As ``validate_training`` but with the per-feature domains."""
    return _check(frame, STRICT, "outside_strict")
