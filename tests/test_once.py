from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.functions import vectors
from ruleweave.functions.once import once
from ruleweave.operators import joins


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_record_is_checked_once_and_behind_the_dealing_of_rows(spark):
    rows = spark.createDataFrame([(i, "{}") for i in range(40)], "id long, features string").repartition(5)
    valid = vectors.spread_codes(vectors.check_vectors(rows)).where(F.col("vector_error").isNotNull())
    plan = plan_of(valid)
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert len(filters) == 1 and "Filter isnotnull(vector_error" in filters[0]
    assert plan.index("Filter") < plan.index("Generate") < plan.index("Repartition")
    assert valid.count() == 40


def test_columns_computed_once_replace_those_of_their_name(spark):
    rows = spark.createDataFrame([(1, 2, 3), (4, 5, None)], "a int, B int, c int")
    found = once(rows, b=F.col("a") + F.col("B"), d=F.col("c") + 1)
    assert found.columns == ["a", "b", "c", "d"]
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 3, 3, 4), (4, 9, None, None)]
    assert once(rows.limit(0), d=F.lit(1)).count() == 0


def test_keys_measured_together_are_as_measured_alone(spark):
    rows = spark.createDataFrame([("x" if i % 3 else None, f"k{i % 7}", i) for i in range(900)], "a string, b string, v long")
    both = joins.measured(rows, ["a", "b"], 100)
    assert both == {key: joins.measured(rows, [key], 100)[key] for key in "ab"}
    assert both["a"] == ([("x", 6)], 900) and len(both["b"][0]) == 7
    table = spark.createDataFrame([("x", 1)], "a string, w int")
    alone, given = (joins.lookup(rows, table, "a", known=k).select("a", "b", "v", "w").collect() for k in (None, both["a"]))
    assert sorted(map(str, alone)) == sorted(map(str, given))
