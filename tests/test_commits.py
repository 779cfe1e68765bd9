from __future__ import annotations

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from helpers import random_rows
from ruleweave.contract import FEATURES, RECORD
from ruleweave.functions import html  # noqa: F401 - the scan is part of routing
from ruleweave.operators import providers, quality
from ruleweave.operators.mining import Mining
from ruleweave.plans import training
from ruleweave.sources import commits, history_store, store
from ruleweave.streaming import routing


def moment():
    return F.lit("2024-02-01 10:00:00").cast("timestamp_ntz")


@pytest.fixture(scope="module")
def model(spark):
    frame = spark.createDataFrame(random_rows(300, 5), RECORD).select(*[F.col(n).cast("int").alias(n) for n in RECORD])
    return training.fit(frame, Mining(0.05, 0.5, 1.0, max_len=3))


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def read(spark, path, key):
    (line,) = commits.current(spark, path, key)
    return sorted(r["v"] for r in spark.read.parquet(f"{path}/t/{line['folder']}").collect())


def test_a_commit_counts_when_it_is_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.current(spark, path) is None
    commits.commit(spark, path, "a", {"t": numbers(spark, 1, 2)})
    broken = numbers(spark, 3).select(F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        commits.commit(spark, path, "a", {"t": numbers(spark, 9), "u": broken})
    assert read(spark, path, "a") == [1, 2]
    commits.commit(spark, path, "b", {"t": numbers(spark, 5)})
    commits.commit(spark, path, "a", {"t": numbers(spark, 3)}, {"n": 1})
    assert read(spark, path, "a") == [3] and read(spark, path, "b") == [5]
    assert [r["key"] for r in commits.current(spark, path)] == ["b", "a"]


def test_model_versions_and_altered_tables(spark, model, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(store.ModelError, match="No model"):
        store.load_model(spark, path)
    first = store.save_model(model, path)
    assert store.save_model(model, path) == first
    (line,) = commits.current(spark, path, store.MODEL_KEY)
    header = spark.read.parquet(f"{path}/header/{line['folder']}").toPandas()
    header["n_samples"] += 1
    spark.createDataFrame(header, model.totals.schema).write.mode("overwrite").parquet(f"{path}/header/{line['folder']}")
    with pytest.raises(store.ModelError, match="failed: header$"):
        store.load_verified_model(spark, path, first)
    again = store.save_model(model, path)
    assert again == first and store.load_verified_model(spark, path, first).rules.count() == model.rules.count()
    (line,) = commits.current(spark, path, store.MODEL_KEY)
    rules = model.rules.withColumn("rank", F.col("rank").cast("long") + 1)
    rules.write.mode("overwrite").parquet(f"{path}/rules/{line['folder']}")
    with pytest.raises(store.ModelError, match="failed: rules$"):
        store.load_verified_model(spark, path, first)


def test_reports_have_one_row(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([(0.5,), (0.6,)], "accuracy double").write.json(f"{path}/evaluation")
    with pytest.raises(Exception, match="more than one row"):
        store.read_report(spark, path, "evaluation", "accuracy double").collect()
    row = store.report_view(spark, str(tmp_path / "none"), model_loaded=False).collect()
    assert len(row) == 1 and row[0]["accuracy"] is None and row[0]["model_name"] == store.MODEL_NAME


VECTOR = "{%s}" % ",".join(f'"{n}":1' for n in FEATURES)
PAGES = [
    (1, " https://known.example.com/a?token=1 ", "<a href='/x'>"), (2, "https://other.example.com/", "<form>"), (3, "http://localhost/", None),
    (4, "https://broken.example.com/", "<p>"), (5, None, "<p>"), (6, "https://known.example.com/a?token=1", None),
]


def lookups(spark):
    vectors = spark.createDataFrame(
        [("https://known.example.com/a?token=1", VECTOR), ("https://broken.example.com/", "{}"), ("http://localhost/", VECTOR)], "url string, features string"
    )
    as_of = F.lit("2024-01-01").cast("timestamp")
    return routing.Lookups(providers.common_suffixes(spark), as_of, vectors=vectors)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "id long, url string, html string")


EXPECTED = {1: "predicted", 2: "feature_mapping_unavailable", 4: "feature_mapping_unavailable", 6: "predicted"}


def states(spark, path):
    rows = history_store.read_history(spark, path).collect()
    assert all(r["prediction"] is not None for r in rows if r["prediction_status"] == "predicted")
    assert not any("token" in r["url"] for r in rows)
    return sorted((r["id"], r["prediction_status"]) for r in rows), sorted((r["id"], r["error"]) for r in routing.read_refused(spark, path).collect())


def test_routes_of_a_batch(spark, model, tmp_path):
    path = str(tmp_path / "h")
    routed = {r["id"]: r["route"] for r in routing.route(frame_of(spark, PAGES), lookups(spark)).collect()}
    assert routed == {1: "scored", 2: "blocked", 3: "refused", 4: "blocked", 5: "refused", 6: "scored"}
    for _ in range(2):  # repeated under its key
        routing.commit_routed(frame_of(spark, PAGES), path, "one", lookups(spark), model.vector_table(), moment())
    kept, refused = states(spark, path)
    assert dict(kept) == EXPECTED and len(kept) == 4 and [i for i, _ in refused] == [3, 5]


def test_stream_and_batch_share_a_history(spark, model, tmp_path):
    path, source, table = str(tmp_path / "h"), str(tmp_path / "pages"), model.vector_table()

    def run():
        stream = spark.readStream.schema("id long, url string, html string").parquet(source)
        routing.route_stream(stream, path, str(tmp_path / "c"), lookups(spark), table, moment()).awaitTermination()

    frame_of(spark, PAGES[:3]).write.parquet(source)
    run()
    run()  # nothing new
    frame_of(spark, PAGES[3:]).write.mode("append").parquet(source)
    run()
    kept, refused = states(spark, path)
    assert dict(kept) == EXPECTED and len(kept) == 4 and len(refused) == 2
    # the last batch again, as after a failure behind its commit
    routing.commit_routed(frame_of(spark, PAGES[3:]), path, "pages-1", lookups(spark), table, moment())
    assert states(spark, path) == (kept, refused)
    routing.commit_routed(frame_of(spark, [(7, *PAGES[1][1:])]), path, "nightly", lookups(spark), table, moment())
    history_store.append_history(history_store.read_history(spark, path).where("id = 1").withColumn("id", F.lit(8).cast("long")).drop("day"), path)
    kept, _ = states(spark, path)
    assert [i for i, _ in kept] == [1, 2, 4, 6, 7, 8]
    day = history_store.read_history(spark, path).where(F.col("day") == datetime(2024, 2, 1).date())
    assert day.count() == 6 and "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()


def test_profile_of_a_wide_column_equals_sql(spark):
    n = 1_000_000
    wide = F.expr("cast(if(id % 10 = 0, null, (id * 7919) % 1000003 - 500000) as int)")
    records = spark.range(n).select(wide.alias(RECORD[0]), *[F.lit(i % 3 - 1).alias(c) for i, c in enumerate(RECORD[1:])], F.expr("id % 5 + 1").alias("n"))
    got = quality.column_profile(records).where(F.col("column_name") == RECORD[0]).first()
    con = duckdb.connect()
    con.execute(
        "CREATE TABLE t AS SELECT CASE WHEN id % 10 = 0 THEN NULL ELSE (id * 7919) % 1000003 - 500000 END AS v "
        f"FROM range({n}) r(id), range(5) w(i) WHERE i < id % 5 + 1"
    )
    want = con.execute(
        "SELECT count(*), count(*) - count(v), count(DISTINCT v) + 1, avg(v), stddev_samp(v), min(v), quantile_cont(v, 0.25), "
        "quantile_cont(v, 0.5), quantile_cont(v, 0.75), max(v) FROM t"
    ).fetchone()
    names = "row_count missing_count unique_count mean std min p25 p50 p75 max".split()
    assert [float(got[c]) for c in names] == pytest.approx([float(x) for x in want], rel=1e-12)
    assert got["domain"] is None


@pytest.mark.parametrize("values", [[], [5], [1, 2], [1, 1, 1, 9], [3, None, 3], list(range(10)), [0, 0, 7, 7, 7, -4]])
def test_quantiles_of_small_columns(spark, values):
    rows = [(v, *[1] * (len(RECORD) - 1), 1) for v in values]
    records = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in RECORD) + ", n long")
    got = quality.column_profile(records).where(F.col("column_name") == RECORD[0]).collect()
    present = sorted(v for v in values if v is not None)
    assert bool(got) == bool(values)
    for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
        if present:
            at = q * (len(present) - 1)
            low, high = present[int(at)], present[min(int(at) + 1, len(present) - 1)]
            assert got[0][name] == pytest.approx(low + (high - low) * (at - int(at)))
