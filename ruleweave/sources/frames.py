"""Inputs derived from the test tables.

Each derivation is row-wise, so its cost grows with the table it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _band(column: str, low: float, high: float) -> Column:
    """Below ``low`` is -1, up to ``high`` is 0, above is 1."""
    return F.when(F.col(column) < low, -1).when(F.col(column) <= high, 0).otherwise(1)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled records from ``lineitem``: ``record_id`` and the ten contract columns."""
    features = {
        "SFH": _band("l_quantity", 17, 34),
        "popUpWidnow": _band("l_discount", 0.03, 0.06),
        "SSLfinal_State": _band("l_tax", 0.03, 0.05),
        "Request_URL": F.when(F.col("l_returnflag") == "A", -1)
        .when(F.col("l_returnflag") == "N", 0)
        .otherwise(1),
        "URL_of_Anchor": _band("l_linenumber", 3, 5),
        "web_traffic": F.col("l_partkey") % 3 - 1,
        "URL_Length": F.col("l_suppkey") % 3 - 1,
        "age_of_domain": F.when(F.col("l_linestatus") == "F", -1).otherwise(1),
        "having_IP_Address": F.when(F.col("l_suppkey") % 10 == 0, 0).otherwise(1),
    }
    record_id = F.concat_ws(
        "-",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("int"),
    )
    z = (
        2 * F.col("SFH")
        + F.col("SSLfinal_State")
        + F.col("Request_URL")
        + (F.col("l_orderkey") % 3 - 1)
    )
    result = F.when(z >= 2, 1).when(z <= -1, -1).otherwise(0)
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            record_id.alias("record_id"),
            "l_orderkey",
            *[code.cast("int").alias(name) for name, code in features.items()],
        )
        .select("record_id", *features, result.alias("Result"))
    )
