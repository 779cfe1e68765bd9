"""Item encoding of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweave.contract import FEATURES, LABELS, SHARED_DOMAIN, TARGET
from ruleweave.functions.keys import item


def label_text(code: Column) -> Column:
    """Label of a target code; NULL for any other value."""
    text = F.lit(None).cast("string")
    for value, label in LABELS.items():
        text = F.when(code == value, F.lit(label)).otherwise(text)
    return text


def feature_items() -> list[Column]:
    """One ``feature=value`` column per feature."""
    return [item(name, F.col(name).cast("int")).alias(name) for name in FEATURES]


def class_item(code: Column | None = None) -> Column:
    code = F.col(TARGET) if code is None else code
    return F.concat(F.lit(f"{TARGET}="), label_text(code))


def transaction() -> Column:
    """The ten items of a labelled record as one array."""
    return F.array(*feature_items(), class_item())


def one_hot() -> list[Column]:
    """One boolean column per possible item, features first, then classes."""
    columns = [
        (F.col(name) == value).alias(f"{name}={value}")
        for name in FEATURES
        for value in SHARED_DOMAIN
    ]
    return columns + [
        (F.col(TARGET) == value).alias(f"{TARGET}={label}") for value, label in LABELS.items()
    ]
