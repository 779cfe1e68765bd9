from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUICK = (
    "validate_summary invalid_values vector_validation provider_vectors class_rules generated_rule_count "
    "class_relative_rules predictions explanations_topk group_split row_split kfold_assignment class_metrics "
    "error_rows threshold_experiments eda_profile url_screening rendered_page_observations domain_age "
    "encode_features rule_evidence feature_distribution dataset_fingerprint item_table_roundtrip"
).split()


def test_registered_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    optional = {name for name in queries if name == "pipeline" or name.startswith("op") and name[2].isdigit()}
    assert set(queries) - set(sql) - optional == {"history_append", "report_sinks"}


@pytest.fixture(scope="module")
def checker(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def every_query():
    return sorted(set(entry.queries()) - {n for n in entry.queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()})


@pytest.mark.parametrize("name", every_query() if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_matches_sql(spark, sf_dir, checker, name):
    frame = entry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = [tuple(map(repr, r)) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in entry.oracle_sql():
        assert got
        return
    answer = checker.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(repr(r[i]) for i in order) for r in answer.fetchall()]
    assert sorted(got) == sorted(want)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 100
