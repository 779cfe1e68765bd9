from __future__ import annotations

import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from helpers import (
    brute_generated,
    brute_itemsets,
    brute_rules,
    constant_rows,
    frame_of,
    items_of,
    random_rows,
)
from ruleweave.contract import FEATURES, LABELS
from ruleweave.functions import items, keys
from ruleweave.operators import mining, ranking, scoring
from ruleweave.operators.mining import Mining
from ruleweave.plans import training

ROWS = random_rows(120)
PARAMS = Mining(0.08, 0.5, 1.0, max_len=4)


@pytest.fixture(scope="module")
def cells(spark):
    return mining.weigh(frame_of(spark, ROWS)).cache()


def test_itemsets_match_brute_force(cells):
    found = {
        tuple(sorted([*r["a"], *([r["c"]] if r["c"] else [])])): r["support"]
        for r in mining.frequent_itemsets(cells, PARAMS)
        .select(
            keys.antecedent(F.col("key")).alias("a"),
            items.class_item(F.col("class")).alias("c"),
            "support",
        )
        .collect()
    }
    assert found == brute_itemsets(ROWS, 0.08, 4)


def test_rules_and_order_match_brute_force(cells):
    found = [
        (tuple(r["antecedent"]), r["class"], r["support"], r["confidence"], r["lift"])
        for r in ranking.mine_ranked(cells, PARAMS).orderBy("rank").collect()
    ]
    assert found == brute_rules(ROWS, 0.08, 0.5, 1.0, 4)


def test_generated_rules_match_brute_force(cells):
    found = mining.generated_rules(mining.frequent_itemsets(cells, PARAMS), [0.3, 0.7]).collect()
    assert {r["min_confidence"]: r["generated_rules"] for r in found} == {
        t: brute_generated(ROWS, 0.08, 4, t) for t in (0.3, 0.7)
    }


def test_itemsets_match_fpgrowth(spark, cells):
    frame = frame_of(spark, ROWS).select(items.transaction().alias("items"))
    other = FPGrowth(itemsCol="items", minSupport=0.08).fit(frame).freqItemsets
    assert mining.frequent_itemsets(cells, Mining(0.08)).count() == other.count()


def test_class_relative_rules(cells):
    found = ranking.class_relative_rules(
        cells, min_support=0.05, max_antecedent_length=2, max_rules_per_class=5
    ).orderBy("rank").collect()
    totals = cells.agg(*[F.sum(c).alias(c) for c in mining.COUNTS]).first()
    expected = []
    for antecedent, label, support, confidence, lift in brute_rules(ROWS, 0.05, 0.5, 1.0, 3):
        relative = support / (totals[(-1, 0, 1).index(label)] / len(ROWS))
        if relative >= 0.05:
            expected.append((antecedent, label, confidence, relative, lift))
    expected.sort(key=lambda r: (-r[2], -r[3], -r[4], len(r[0]), r[0], r[1]))
    best = [r for c in LABELS for r in [e for e in expected if e[1] == c][:5]]
    best.sort(key=lambda r: (-r[2], -r[3], -r[4], len(r[0]), r[0], r[1]))
    got = [
        (tuple(r["antecedent"]), r["class"], r["confidence"], r["relative_support"], r["lift"])
        for r in found
    ]
    assert got == best


def test_frequencies_are_kept(spark):
    rows = constant_rows(1, 1, 3) + constant_rows(-1, -1, 2)
    totals = mining.class_totals(mining.weigh(frame_of(spark, rows))).first()
    assert (totals["n_samples"], totals["legitimate"], totals["majority_class"]) == (5, 3, 1)
    rules = ranking.mine_ranked(mining.weigh(frame_of(spark, rows)), Mining(0.2, 0.5))
    best = rules.where(F.col("rank") == 1).first()
    # The rarer class has the higher lift; the longest antecedent wins among its rules.
    assert (best["class"], best["antecedent_length"], best["lift"]) == (-1, 9, 2.5)


def test_majority_tie_takes_the_smaller_label(spark):
    rows = constant_rows(1, 1, 2) + constant_rows(0, 0, 2)
    assert mining.class_totals(mining.weigh(frame_of(spark, rows))).first()["majority_class"] == 0


def test_fallback_without_rules(spark):
    rows = constant_rows(1, 1, 3) + constant_rows(-1, -1, 1)
    model = training.fit(frame_of(spark, rows), Mining(0.9, 0.99))
    scored = scoring.score(frame_of(spark, rows), model.vector_table()).collect()
    assert {(r["predicted"], r["matching_rule_count"], r["rank"]) for r in scored} == {(1, 0, None)}


def test_equi_matches_equal_subset_tests(spark, cells):
    rules = ranking.mine_ranked(cells, PARAMS).cache()
    vectors = cells.select(F.col("key").alias("vector"))
    fast = scoring.matches(rules).join(vectors, "vector", "left_semi")
    slow = scoring.matches_by_subset_test(vectors, rules)
    columns = ["run", "vector", "rank", "class", "rule"]
    as_set = lambda frame: {tuple(r) for r in frame.select(*columns).collect()}
    assert as_set(fast) == as_set(slow)
    assert len(as_set(fast)) > 100


def test_predictions_match_brute_force(spark, cells):
    model = training.fit_cells(cells, PARAMS)
    rules = brute_rules(ROWS, 0.08, 0.5, 1.0, 4)
    majority = model.totals.first()["majority_class"]
    scored = scoring.score(frame_of(spark, ROWS), model.vector_table()).collect()
    for r in scored:
        owned = set(items_of(tuple(r[name] for name in (*FEATURES, "Result"))))
        hits = [rule for rule in rules if set(rule[0]) <= owned]
        assert r["matching_rule_count"] == len(hits)
        assert r["predicted"] == (hits[0][1] if hits else majority)


def test_runs_do_not_mix(spark):
    frame = frame_of(spark, ROWS).withColumn("half", F.monotonically_increasing_id() % 2)
    both = mining.weigh(frame, F.col("half"))
    one = mining.weigh(frame.where("half = 1"), "1")
    key = lambda rules: {
        (tuple(r["antecedent"]), r["class"], r["rank"]) for r in rules.collect()
    }
    together = ranking.mine_ranked(both, PARAMS).where("run = '1'")
    assert key(together) == key(ranking.mine_ranked(one, PARAMS))


@pytest.mark.parametrize("bad", [dict(min_support=0), dict(min_confidence=1.5), dict(min_lift=-1)])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        Mining(**bad)


RULES = [
    ("wide", ["web_traffic=-1"], 0.75, 1.25, 0.4, -1),
    ("pair", ["URL_Length=1", "web_traffic=-1"], 0.75, 1.25, 0.4, 0),
    ("sure", ["web_traffic=-1"], 0.95, 1.1, 0.05, 0),
    ("other", ["web_traffic=0"], 0.99, 3.0, 0.3, -1),
    ("lone", ["Request_URL=-1", "URL_Length=1"], 0.6, 1.75, 0.15, 1),
]


def hand_rules(spark):
    rows = []
    for name, antecedent, confidence, lift, support, label in RULES:
        key = 0
        for item in antecedent:
            feature, value = item.split("=")
            key |= (int(value) + 2) << (2 * FEATURES.index(feature))
        rows.append(("model", key, antecedent, f"Result={LABELS[label]}", support, confidence, lift, len(antecedent), label))
    schema = (
        "run string, key int, antecedent array<string>, consequent string, support double, "
        "confidence double, lift double, antecedent_length int, class int"
    )
    return spark.createDataFrame(rows, schema)


def test_hand_made_rules_rank_and_match(spark):
    ranked = ranking.rank_rules(hand_rules(spark))
    order = [(r["antecedent"], r["confidence"]) for r in ranked.orderBy("rank").collect()]
    assert [c for _, c in order] == [0.99, 0.95, 0.75, 0.75, 0.6]
    assert order[2][0] == ["URL_Length=1", "web_traffic=-1"]  # the longer one of a tie
    codes = {"URL_Length": 1, "web_traffic": -1, "Request_URL": -1}
    vector = sum((codes.get(n, 0) + 2) << (2 * i) for i, n in enumerate(FEATURES))
    hits = scoring.matches(ranked).where(F.col("vector") == vector).orderBy("rank").collect()
    assert [(h["class"], h["rank"]) for h in hits] == [(0, 2), (0, 3), (-1, 4), (1, 5)]
    evidence = scoring.feature_evidence(scoring.matches(ranked).where(F.col("vector") == vector))
    counts = {r["feature"]: (r["matching_rule_count"], r["strongest_rank"]) for r in evidence.collect()}
    assert counts["web_traffic"] == (3, 2) and counts["URL_Length"] == (2, 3) and counts["Request_URL"] == (1, 5)
    assert counts["SFH"] == (0, None)


def test_class_breaks_full_ties(spark):
    rules = hand_rules(spark).where("size(antecedent) = 1 AND confidence = 0.75")
    tied = rules.unionByName(rules.withColumn("class", F.lit(1)))
    first = ranking.rank_rules(tied).where("rank = 1").first()
    assert first["class"] == -1


def test_upper_median(spark):
    ranked = ranking.rank_rules(hand_rules(spark))
    row = ranking.rule_characteristics(ranked).where("field = 'lift'").first()
    assert (row["rules"], row["min"], row["median"], row["max"]) == (5, 1.1, 1.25, 3.0)
    row = ranking.rule_characteristics(ranked.where("rank < 5")).where("field = 'confidence'").first()
    assert (row["rules"], row["median"]) == (4, 0.95)  # not the mean with 0.75
    kept = ranking.filter_rules(ranked, min_confidence=0.7, min_lift=1.2).orderBy("rank")
    assert [r["rank"] for r in kept.collect()] == [1, 3, 4]
