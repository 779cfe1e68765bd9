from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from helpers import constant_rows, frame_of
from ruleweave.contract import FEATURES, ContractError
from ruleweave.functions import items, vectors
from ruleweave.operators import quality, validate
from ruleweave.sources import tables

GOOD = [(1, 1, 1, 1, 1, 1, 1, 1, 1, 1), (-1, -1, 0, -1, 0, -1, -1, -1, 0, -1)]


def test_duplicates_are_kept(spark):
    frame = frame_of(spark, GOOD[:1] * 2).withColumn("more", F.lit(1))
    checked = validate.validate_training(frame)
    assert checked.count() == 2 and "more" not in checked.columns


@pytest.mark.parametrize(
    "column, value, text",
    [
        ("URL_of_Anchor", 5, r"'URL_of_Anchor' contains invalid values \[5\]"),
        ("web_traffic", None, "'web_traffic' contains missing values"),
        ("Result", -7, r"Target column 'Result' contains invalid values \[-7\]"),
        ("Result", None, "Target column 'Result' contains missing values"),
    ],
)
def test_training_rejects(spark, column, value, text):
    frame = frame_of(spark, GOOD).withColumn(column, F.lit(value).cast("int"))
    with pytest.raises(ContractError, match=text):
        validate.validate_training(frame)


def test_missing_columns_are_all_listed(spark):
    with pytest.raises(ContractError, match="SFH, Result"):
        validate.validate_training(frame_of(spark, GOOD).drop("SFH", "Result"))


@pytest.mark.parametrize("column, value", [("age_of_domain", 0), ("having_IP_Address", -1)])
def test_strict_domains(spark, column, value):
    frame = frame_of(spark, GOOD).withColumn(column, F.lit(value))
    assert validate.validate_training(frame).count() == 2
    with pytest.raises(ContractError, match=column):
        validate.validate_dataset(frame)


def test_csv_reading(spark, tmp_path):
    header = ",".join(["extra", "Result", *FEATURES])
    (tmp_path / "rows.csv").write_text(header + "\nx,1," + ",".join(["1"] * 9) + "\n")
    loaded = tables.load_training(spark, str(tmp_path / "rows.csv"))
    assert [tuple(r) for r in loaded.collect()] == [(1,) * 10]
    (tmp_path / "bad.csv").write_text(header + "\nx,1,oops," + ",".join(["1"] * 8) + "\n")
    with pytest.raises(ContractError, match="'SFH' contains invalid values"):
        tables.load_training(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_training(spark, str(tmp_path / "none.csv"))


def test_items(spark):
    row = frame_of(spark, GOOD[1:]).select(items.transaction().alias("t")).first()["t"]
    assert row[0] == "SFH=-1" and row[-1] == "Result=Phishy" and len(row) == 10


def vector(**changes):
    base = {name: "0" for name in FEATURES} | {"age_of_domain": "1"} | changes
    return json.dumps({k: v for k, v in base.items() if v != "drop"})


CASES = [
    (vector(), None),
    ("{}", "Live feature record is missing required features: " + ", ".join(FEATURES)),
    (vector(SFH="drop"), "Live feature record is missing required features: SFH"),
    (vector(zz=1, aa=1), "Live feature record contains unsupported features: aa, zz"),
    (vector(URL_Length="long"), "Feature 'URL_Length' must be an integer"),
    (vector(Request_URL="4"), "Feature 'Request_URL' has invalid value 4; expected [-1, 0, 1]"),
    (vector(web_traffic=None), "Feature 'web_traffic' must be an integer"),
    (vector(SFH="1.7"), "Feature 'SFH' must be an integer"),
    (vector(SFH=1.7), None),
    (vector(SFH=" 1 "), None),
    (vector(SFH=True), None),
    (vector(SFH={"a": 1}), "Feature 'SFH' must be an integer"),
    (vector(age_of_domain="0"), "Feature 'age_of_domain' has invalid value 0; expected [-1, 1]"),
    (vector(having_IP_Address=-1), "Feature 'having_IP_Address' has invalid value -1; expected [0, 1]"),
    ("not json", "Live feature record is missing required features: " + ", ".join(FEATURES)),
]


def test_vectors(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, features string")
    checked = vectors.spread_codes(vectors.check_vectors(frame)).orderBy("id").collect()
    assert [r["vector_error"] for r in checked] == [c[1] for c in CASES]
    assert checked[0]["age_of_domain"] == 1 and checked[4]["SFH"] is None
    assert [checked[i]["SFH"] for i in (8, 9, 10)] == [1, 1, 1]


def test_counted_codes_skip_text(spark):
    frame = spark.createDataFrame([(vector(SFH=1, popUpWidnow=True),)], "features string")
    row = vectors.check_vectors(frame).select(vectors.counted_codes().alias("c")).first()["c"]
    assert [(c["feature"], c["value"]) for c in row] == [("SFH", 1), ("popUpWidnow", 1)]


def test_quality(spark):
    rows = constant_rows(1, 1, 3) + constant_rows(1, 0, 1) + constant_rows(-1, -1, 1)
    records = quality.distinct_records(frame_of(spark, rows))
    row = quality.quality_summary(records).first().asDict()
    assert (row["row_count"], row["duplicate_rows"], row["unique_rows"]) == (5, 2, 3)
    assert (row["feature_group_count"], row["conflicting_group_count"]) == (2, 1)
    conflict = quality.conflicting_groups(records).first()
    assert (conflict["phishy"], conflict["suspicious"], conflict["legitimate"]) == (0, 1, 3)


def test_profile_against_pandas(spark):
    from helpers import random_rows

    rows = random_rows(200, 3)
    pdf = frame_of(spark, rows).toPandas()
    records = quality.distinct_records(frame_of(spark, rows))
    described = pdf.describe()
    for r in quality.column_profile(records).collect():
        d = described[r["column_name"]]
        for ours, theirs in (("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
            assert r[ours] == pytest.approx(d[theirs])
    corr = pdf.corr()
    for r in quality.correlation_matrix(records).collect():
        assert r["correlation"] == pytest.approx(corr.loc[r["column_a"], r["column_b"]])


def test_all_bad_values_come_as_rows(spark):
    rows = [(1,) * 9 + (1,)] + [(10 + i % 50, *[1] * 9) for i in range(100)]
    with pytest.raises(ContractError, match=r"invalid values \[10, .*, 29\], \.\.\.|invalid values \[10, .*\.\.\.") as caught:
        validate.validate_training(frame_of(spark, rows))
    found = {int(r["value"]): r["row_count"] for r in caught.value.invalid.collect()}
    assert found == {v: 2 for v in range(10, 60)}
