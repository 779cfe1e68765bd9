from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleweave.contract import FEATURES
from ruleweave.functions import dates, suffixes
from ruleweave.operators import joins, providers

# -- hot keys ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{rng.randrange(400)}", "p", 0) for i in range(9000)]
    left = spark.createDataFrame(rows, "id long, key string, parts string, salt int")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(300)], "key string, value int")
    return left, right, rows


def test_lookup_keeps_every_row_once(skewed):
    left, right, rows = skewed
    values = {r["key"]: r["value"] for r in right.collect()}
    found = joins.lookup(left, right, "key", rows_per_part=500)
    assert sorted(found.columns) == sorted([*left.columns, "value"])
    got = sorted((r["id"], r["key"] or "", r["parts"], r["salt"], r["value"]) for r in found.collect())
    assert got == sorted((i, k or "", p, s, values.get(k)) for i, k, p, s in rows)


def test_only_hot_keys_are_repeated_and_rows_without_key_dealt_out(spark, skewed):
    left, right, _ = skewed
    assert joins.hot_keys(left, "key", 500) == [("hot", 6)]
    assert joins.hot_keys(left, "key", 10_000) == []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = joins.lookup(left, right, "key", rows_per_part=500).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in found) < 1800  # 3,000 rows have the hot key, 3,000 none
        plan = joins.lookup(left, right, "key", rows_per_part=500)
        assert plan.where("value is not null").select("key").where("key <> 'hot'").count() == left.join(right, "key").where("key <> 'hot'").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lookup_of_empty_tables(spark, skewed):
    left, right, _ = skewed
    assert joins.lookup(left.limit(0), right, "key").count() == 0
    assert joins.lookup(left, right.limit(0), "key").where("value is null").count() == 9000


# -- public suffixes --------------------------------------------------------------


def brute(rules, host):
    """Compares every rule with the host, label by label."""
    labels = (host or "").strip(" ").lower().rstrip(".").split(".")
    if host is None or "" in labels:
        return None
    best, exception = 0, None
    for rule in rules:
        parts = rule.lstrip("!").split(".")
        if len(parts) <= len(labels) and all(p in ("*", own) for p, own in zip(reversed(parts), reversed(labels))):
            if rule.startswith("!"):
                exception = max(exception or 0, len(parts) - 1)
            else:
                best = max(best, len(parts))
    length = best if exception is None else exception
    return ".".join(labels[-length - 1 :]) if 0 < length < len(labels) else None


LABEL = st.sampled_from(["a", "b", "c", "d"])
NAME = st.lists(LABEL, min_size=1, max_size=4).map(".".join)


@given(st.lists(NAME, max_size=8), st.lists(NAME, max_size=3), st.lists(st.tuples(NAME, LABEL), max_size=3), st.lists(NAME, min_size=1, max_size=8))
@settings(max_examples=500, deadline=None)
def test_trie_against_comparing_every_rule(plain, wild, exceptions, hosts):
    wild = wild + [name for name, _ in exceptions]
    rules = plain + [f"*.{n}" for n in wild] + [f"!{label}.{name}" for name, label in exceptions]
    root = suffixes.trie(rules)
    for host in hosts:
        kept = [r for r in rules if r.startswith("!")]
        fitting = [r for r in kept if host == r[1:] or host.endswith("." + r[1:])]
        if len({r.count(".") for r in fitting}) > 1:  # nested exceptions do not occur in lists
            continue
        assert suffixes.registrable(root, host) == brute(rules, host)


def test_ten_thousand_rules_in_one_pass(spark):
    rng = random.Random(1)
    names = [f"l{i}" for i in range(60)]
    rules = list({".".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(11_000)})
    rules += ["*.wild", "!keep.wild", "*.l1.wild"]
    hosts = [".".join(rng.choice([*names, "x", "wild", "keep"]) for _ in range(rng.randint(1, 6))) for _ in range(300)] + [None, "", "a..l1", "L1.L2. "]
    table = spark.createDataFrame([(r,) for r in rules + [None]], "rule string")
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    found = providers.registrable_domain(frame, "host", table)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        assert r["registrable_domain"] == brute(rules, r["host"]), r["host"]
    assert providers.registrable_domain(frame, "host", table.limit(0)).where("registrable_domain is not null").count() == 0


def test_reading_a_list(spark, tmp_path):
    text = "// a comment\n// ===BEGIN ICANN DOMAINS===\ncom\n\n  co.uk  trailing words\r\n*.ck\n!www.ck\n公司.cn\n// ===BEGIN PRIVATE DOMAINS===\nblog.example\n"
    (tmp_path / "list.dat").write_bytes(text.encode())
    read = lambda **k: {r["rule"] for r in suffixes.read_suffix_list(spark, str(tmp_path / "list.dat"), **k).collect()}
    assert read() == {"com", "co.uk", "*.ck", "!www.ck", "公司.cn", "blog.example"}
    assert read(private=False) == read() - {"blog.example"}
    root = suffixes.trie(read())
    assert suffixes.registrable(root, "shop.公司.cn") == "shop.公司.cn"
    assert suffixes.registrable(root, "shop.xn--55qx5d.cn") == "shop.xn--55qx5d.cn"


# -- dates --------------------------------------------------------------------------

DAYS = [
    "2020-01-01", "20200229", "2021-02-29", "2020-W53-7", "2021-W53-1", "2020W011", "2020W01", "2020-W00", "2020-W01-8", "0001-01-01",
    "0000-01-01", "9999-12-31", "2020-1-01", "2020-001", "2020001", "2020-0101", "202001-01", "2020-W1", "20-01-01", "1969-12-31", "2004-W01-1",
]
TIMES = [
    "", "T10", "T10:30", "T1030", "T10:30:15", "T103015", "T10:30:15.5", "T10:30:15,123456789", "T103015.25", " 23:59:59.999999", "x00",
    "T24:00", "T10:60", "T10:30:60", "T1", "T10:3", "T10:3015", "T1030:15", "T",
]
ZONES = ["", "Z", "+05", "-05:30", "+0130", "+01:30:15", "-013015", "+00:00:00.5", "+24:00", "+1", "+01:3", "z"]


def test_dates_equal_the_standard_library(spark):
    texts = [d + t + z for d in DAYS for t in TIMES for z in ZONES if t or not z] + ["", "junk", " 2020-01-01", "2020-01-01 ", "2020-01-01\n", None]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in frame.select("text", F.unix_micros(dates.parse_date(F.col("text"))).alias("micros")).collect():
        try:
            value = datetime.fromisoformat(r["text"].replace("Z", "+00:00"))
            value = value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value
            gap = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
            expected = (gap.days * 86_400 + gap.seconds) * 1_000_000 + gap.microseconds
        except (ValueError, AttributeError):
            expected = None
        assert r["micros"] == expected, r["text"]


# -- provider vectors ---------------------------------------------------------------


def test_provider_vectors_are_screened_and_unique(spark):
    good = "{%s}" % ",".join(f'"{n}":1' for n in FEATURES)
    other = "{%s}" % ",".join(f'"{n}":0' for n in FEATURES)
    rows = [("https://a.example/", good), ("https://a.example/", other), ("https://b.example/", None), ("http://localhost/", good), (None, good)]
    provider = spark.createDataFrame(rows, "url string, features string")
    requests = spark.createDataFrame(
        [(1, " https://a.example/ "), (2, "https://b.example/"), (3, "http://localhost/"), (4, "ftp://a.example/"), (5, None), (6, "https://a.example/")],
        "id int, url string",
    )
    found = {r["id"]: r for r in providers.provider_vectors(requests, provider).collect()}
    assert len(found) == 6
    assert found[6]["vector_error"] == found[1]["vector_error"] is not None or found[1]["SFH"] == found[6]["SFH"]
    assert found[2]["vector_error"] == "Trusted feature provider failed"
    assert found[3]["vector_error"] == "Internal hostnames are not allowed"
    assert found[4]["vector_error"] and found[5]["vector_error"] == "Enter a valid URL"
    bare = {r["id"]: r["vector_error"] for r in providers.provider_vectors(requests, None).collect()}
    assert bare[3] == "Internal hostnames are not allowed" and "mapping_unverified" in bare[1]


def test_tasks_of_a_lookup_and_of_a_table_grow_with_the_rows(spark, tmp_path):
    from ruleweave.session import spread

    spark.range(2_000).coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert spread(rows, 100).rdd.getNumPartitions() == 20
    left = rows.selectExpr("if(id % 10 = 0, null, id % 50) AS key", "id", "repeat('x', 100) AS wide")
    right = spark.range(40).selectExpr("id AS key", "id * 2 AS twice")
    found = joins.lookup(left, right, "key", rows_per_task=100)
    assert found.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, found.select("id", "twice").collect())) == sorted(
        (i, 2 * (i % 50) if i % 10 and i % 50 < 40 else None) for i in range(2_000)
    )
