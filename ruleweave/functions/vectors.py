"""Checks of live feature vectors given as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.contract import DOMAINS, FEATURES
from ruleweave.functions.once import once


def add_raw_values(frame: DataFrame, text: str = "features") -> DataFrame:
    """Add ``names`` (the JSON keys) and ``raw``: text and JSON type per feature.

    Types are told apart because the text "1.7" is no integer while the number
    1.7 truncates to 1, and because text values do not count as codes.
    """
    parsed = frame.withColumn("document", F.try_parse_json(F.col(text)))
    values = [
        F.struct(
            F.try_variant_get("document", f"$.{name}", "string").alias("text"),
            F.schema_of_variant(F.try_variant_get("document", f"$.{name}", "variant")).alias("type"),
        )
        for name in FEATURES
    ]
    return parsed.withColumn("names", F.json_object_keys(F.col(text))).withColumn(
        "raw", F.array(*values)
    ).drop("document")


def _is_fraction(kind: Column) -> Column:
    return kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _integer(cell: Column) -> Column:
    """Whole number of one raw value; NULL if it is none."""
    text, kind = cell["text"], cell["type"]
    return (
        F.when(kind == "BIGINT", text.try_cast("long"))
        .when(_is_fraction(kind), text.try_cast("double").try_cast("long"))
        .when((kind == "STRING") & text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long"))
        .when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0).cast("long"))
    )


def _domains() -> Column:
    """Name and domain of every feature, in contract order."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.array(*[F.lit(v).cast("long") for v in sorted(DOMAINS[name])]).alias("values"),
            )
            for name in FEATURES
        ]
    )


def _failure(code: Column, domain: Column) -> Column:
    allowed = F.array_join(domain["values"].cast("array<string>"), ", ")
    return F.when(
        code.isNull(), F.concat(F.lit("Feature '"), domain["name"], F.lit("' must be an integer"))
    ).when(
        ~F.array_contains(domain["values"], code),
        F.concat(
            F.lit("Feature '"),
            domain["name"],
            F.lit("' has invalid value "),
            code.cast("string"),
            F.lit("; expected ["),
            allowed,
            F.lit("]"),
        ),
    )


def check_vectors(frame: DataFrame, text: str = "features") -> DataFrame:
    """Add ``vector_error`` (first failure, NULL if valid) and ``codes`` (nine integers).

    Order of checks: missing keys, extra keys, then per feature integer and domain.
    """
    frame = once(add_raw_values(frame, text), codes=F.transform("raw", _integer))
    present = F.coalesce(F.col("names"), F.array().cast("array<string>"))
    expected = F.array(*[F.lit(name) for name in FEATURES])
    missing = F.array_join(F.array_except(expected, present), ", ")
    extra = F.array_join(F.array_sort(F.array_except(present, expected)), ", ")
    failures = F.filter(
        F.zip_with("codes", _domains(), _failure), lambda message: message.isNotNull()
    )
    error = (
        F.when(
            missing != "",
            F.concat(F.lit("Live feature record is missing required features: "), missing),
        )
        .when(
            extra != "",
            F.concat(F.lit("Live feature record contains unsupported features: "), extra),
        )
        .otherwise(F.get(failures, F.lit(0)))
    )
    return once(frame, vector_error=error)


def spread_codes(frame: DataFrame) -> DataFrame:
    """The checked codes as nine int columns; NULL for refused vectors."""
    kept = frame.withColumn("accepted", F.when(F.col("vector_error").isNull(), F.col("codes")))
    return kept.withColumns(
        {name: F.col("accepted")[i].cast("int") for i, name in enumerate(FEATURES)}
    ).drop("accepted")


def counted_codes() -> Column:
    """``feature, value`` of the codes that enter distributions.

    JSON numbers and booleans in the domain count; text does not.
    """

    def counted(cell: Column, domain: Column) -> Column:
        text, kind = cell["text"], cell["type"]
        value = F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).when(
            (kind == "BIGINT") | _is_fraction(kind), text.try_cast("double")
        )
        inside = F.array_contains(domain["values"].cast("array<double>"), value)
        return F.struct(
            domain["name"].alias("feature"), F.when(inside, value.cast("int")).alias("value")
        )

    return F.filter(
        F.zip_with("raw", _domains(), counted), lambda entry: entry["value"].isNotNull()
    )
