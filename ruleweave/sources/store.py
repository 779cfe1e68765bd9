"""Stored models, rule exports and reports."""

from __future__ import annotations

import json
import warnings
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ruleweave.contract import FEATURES
from ruleweave.operators.fingerprint import fingerprint
from ruleweave.plans.training import Model
from ruleweave.sources import commits

MODEL_KEY = "model"

# Artifact versions by model kind, and the stated rule orders.
VERSIONS = {"strength": 2, "class_relative": 1}
ORDERS = {
    "strength": "confidence, lift, support, length descending, class, antecedent ascending",
    "class_relative": "confidence, relative support, lift descending, length, antecedent, class ascending",
}


MODEL_NAME, MODEL_TYPE = "associative_classifier", "Associative Classification"


class ModelError(RuntimeError):
    """A stored model is missing, unfitted, of another version or altered."""


def _flat(rules: DataFrame) -> DataFrame:
    return rules.withColumn("antecedent", F.array_join("antecedent", "|"))


def rules_digest(rules: DataFrame) -> str:
    return fingerprint(_flat(rules)).first()["digest"]


def table_digests(model: Model) -> dict[str, str]:
    """Fingerprints of header and rules, each with the names and types of its columns."""

    def digest(table: DataFrame) -> str:
        kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(table.schema, key=lambda f: f.name))
        return sha256(f"{kinds};{fingerprint(table).first()['digest']}".encode()).hexdigest()

    return {"header": digest(model.totals), "rules": digest(_flat(model.rules))}


def model_digest(digests: dict[str, str], kind: str) -> str:
    """One fingerprint over those of the tables, the kind and its version."""
    parts = [f"{name}={value}" for name, value in sorted(digests.items())]
    return sha256(";".join([*parts, kind, str(VERSIONS[kind])]).encode()).hexdigest()


def save_model(model: Model, path: str, kind: str = "strength") -> str:
    """Commit rules and header as one version; returns the fingerprint of the whole model.

    Readers see the version before until all of this one is written.  An unfitted
    model (no rows seen) is refused.
    """
    spark = model.rules.sparkSession
    totals = model.totals.collect()
    if len(totals) != 1 or not totals[0]["n_samples"]:
        raise ModelError("Cannot save an unfitted classifier")
    digests = table_digests(model)
    facts = {"kind": kind, "artifact_version": VERSIONS[kind], "digests": digests}
    commits.commit(spark, path, MODEL_KEY, {"rules": model.rules, "header": model.totals}, facts)
    return model_digest(digests, kind)


def _stored(spark: SparkSession, path: str, kind: str) -> tuple[Model, dict]:
    lines = commits.current(spark, path, MODEL_KEY)
    if not lines:
        raise ModelError("No model is stored here")
    facts = json.loads(lines[0]["facts"])
    if facts.get("kind") != kind or facts.get("artifact_version") != VERSIONS[kind]:
        raise ModelError("Unsupported classifier artifact")
    rules, header = (spark.read.parquet(f"{path}/{name}/{lines[0]['folder']}") for name in ("rules", "header"))
    return Model(rules, header), facts


def load_model(spark: SparkSession, path: str, kind: str = "strength") -> Model:
    """Read the latest stored model of the expected kind and version."""
    return _stored(spark, path, kind)[0]


def load_verified_model(
    spark: SparkSession,
    path: str,
    expected: str | None = None,
    strict: bool = False,
    kind: str = "strength",
) -> Model:
    """Read a stored model only if header and rules have the expected fingerprint.

    Without an expected value this is an error in strict mode and a warning
    otherwise.  The error names the tables that are not as they were written.
    """
    if not expected:
        if strict:
            raise ModelError("A model fingerprint is required in strict mode")
        warnings.warn("No model fingerprint given; the model is unverified", RuntimeWarning, 2)
    model, facts = _stored(spark, path, kind)
    if expected:
        digests = table_digests(model)
        if model_digest(digests, kind) != expected.strip().lower():
            altered = [name for name, value in digests.items() if facts["digests"].get(name) != value]
            raise ModelError(f"Model integrity check failed: {', '.join(altered) or 'another model'}")
    return model


def export_rules_csv(rules: DataFrame, path: str) -> None:
    """Ranked rules as CSV with the antecedent as ``|``-joined items."""
    _flat(rules.drop("run", "key")).orderBy("rank").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def export_rules_json(rules: DataFrame, path: str, kind: str) -> None:
    """Ranked rules as JSON lines, each with the stated rule order."""
    rules.drop("run", "key").withColumn("ranking", F.lit(ORDERS[kind])).orderBy(
        "rank"
    ).write.mode("overwrite").json(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """A report as one JSON-lines folder per named table."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


# Report fields the dashboard shows.
EVALUATION_FIELDS = (
    "accuracy double, macro_precision double, macro_recall double, macro_f1 double, weighted_f1 double"
)
QUALITY_FIELDS = (
    "row_count long, duplicate_rows long, unique_rows long, "
    "conflicting_group_count long, missing_values long"
)
MANIFEST_FIELDS = "rules_digest string, dataset_digest string"


def read_report(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The one row of a report table; all fields NULL if the report is absent.

    A table with several rows is no such report and ends the query with an error.
    """
    try:
        rows = spark.read.schema(schema).json(f"{path}/{name}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], schema)
    several = F.raise_error(F.lit(f"Report {name!r} has more than one row"))
    one = F.when(F.count("*") > 1, several.cast("boolean")).otherwise(True).alias("one_row")
    return rows.agg(one, *[F.first(f.name).alias(f.name) for f in rows.schema]).where("one_row").drop("one_row")


def report_view(
    spark: SparkSession, path: str, model_loaded: bool, verified: bool = False
) -> DataFrame:
    """One row with the evaluation, quality and model state fields of a report.

    The three parts are one-row tables, joined by a constant number.
    """

    def part(name: str, schema: str) -> DataFrame:
        return read_report(spark, path, name, schema).withColumn("part", F.lit(1))

    state = "Verified" if verified and model_loaded else "Integrity verification not configured"
    return (
        part("evaluation", EVALUATION_FIELDS)
        .join(part("quality", QUALITY_FIELDS), "part")
        .join(part("manifest", MANIFEST_FIELDS), "part")
        .drop("part")
        .withColumn("feature_names", F.lit(",".join(FEATURES)))
        .withColumn("model_name", F.lit(MODEL_NAME))
        .withColumn("model_type", F.lit(MODEL_TYPE))
        .withColumn("model_loaded", F.lit(model_loaded))
        .withColumn("integrity", F.lit(state))
    )


def manifest(
    records: DataFrame, model: Model, evaluation: DataFrame, kind: str = "strength"
) -> DataFrame:
    """One row: fingerprints of data and rules, sizes and the headline metrics.

    ``records`` are the distinct records of the data with their count ``n``.
    """
    data = fingerprint(records, weight="n").first()
    return evaluation.select(
        F.lit(MODEL_NAME).alias("model_name"),
        F.lit(MODEL_TYPE).alias("model_type"),
        F.lit(VERSIONS[kind]).alias("artifact_version"),
        F.lit(data["row_count"]).alias("dataset_rows"),
        F.lit(data["digest"]).alias("dataset_digest"),
        F.lit(rules_digest(model.rules)).alias("rules_digest"),
        "accuracy",
        "macro_f1",
        "weighted_f1",
    )

