from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ruleweave.operators import open_items
from ruleweave.operators.mining import Mining


def wide(n, seed=2):
    rng = random.Random(seed)
    names = [f"i{k}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(40)]
    rows = []
    for i in range(n):
        own = set(rng.choices(names, weights, k=rng.randint(0, 8)))
        label = "good" if "i1" in own else rng.choice(["good", "bad", None])
        rows.append((i, sorted(own), label))
    return rows


def brute_rules(rows, mining):
    n, counts, joint, classes = len(rows), {}, {}, {}
    for _, own, label in rows:
        if label is not None:
            classes[label] = classes.get(label, 0) + 1
        for size in range(1, len(own) + 1):
            for part in combinations(sorted(own), size):
                counts[part] = counts.get(part, 0) + 1
                if label is not None:
                    joint[part, label] = joint.get((part, label), 0) + 1
    out = {}
    for (part, label), c in joint.items():
        support = c / n
        confidence = support / (counts[part] / n)
        lift = confidence / (classes[label] / n)
        if support >= mining.min_support and confidence >= mining.min_confidence and lift >= mining.min_lift:
            if mining.max_len is None or len(part) < mining.max_len:
                out[part, label] = (support, confidence, lift, len(part))
    return out


@pytest.mark.parametrize("mining", [Mining(0.02, 0.5, 1.0), Mining(0.01, 0.3, 0.0, max_len=3)])
def test_rules_of_wide_items(spark, mining):
    rows = wide(400)
    noisy = [(i, [*own, *own[:1], None], label) for i, own, label in rows]
    frame = spark.createDataFrame(noisy, "id int, items array<string>, consequent string")
    found = open_items.class_rules(frame, mining).collect()
    got = {(tuple(r["antecedent"]), r["consequent"]): (r["support"], r["confidence"], r["lift"], r["antecedent_length"]) for r in found}
    assert len(got) == len(found) and got == brute_rules(rows, mining) and len(got) > 10


def test_matches_against_a_nested_loop(spark):
    rows = wide(300, 7)
    rng = random.Random(5)
    rules = [(k, rng.sample([f"i{j}" for j in range(42)], rng.randint(0, 4))) for k in range(250)] + [(900, None), (901, ["i0", "i0", None])]
    baskets = spark.createDataFrame([(i, own) for i, own, _ in rows] + [(1000, None)], "id int, items array<string>")
    table = spark.createDataFrame(rules, "rule int, antecedent array<string>")
    got = sorted(map(tuple, open_items.matches(baskets, table).collect()))
    want = [(i, k) for i, own, _ in rows for k, rule in rules if rule and set(filter(None, rule)) <= set(own)]
    assert got == sorted(want) and len(got) > 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, items array<string>, consequent string")
    assert open_items.class_rules(none, Mining()).count() == 0
    rules = spark.createDataFrame([(1, ["a"])], "rule int, antecedent array<string>")
    assert open_items.matches(none, rules).count() == 0
    assert open_items.matches(none.unionByName(spark.createDataFrame([(1, ["a"], None)], none.schema)), rules.limit(0)).count() == 0
    assert open_items.class_rules(spark.createDataFrame([(1, [], "x"), (2, None, None)], none.schema), Mining()).where(F.lit(True)).count() == 0


def test_equal_baskets_are_mined_once(spark, monkeypatch):
    rows = [(i, ["a", "b"] if i % 2 else ["a"], "good") for i in range(300)]
    seen, mine = [], open_items.frequent_sets
    monkeypatch.setattr(open_items, "frequent_sets", lambda baskets, least: seen.append(baskets.count()) or mine(baskets, least))
    frame = spark.createDataFrame(rows, "id int, items array<string>, consequent string")
    got = {tuple(r["antecedent"]): r["support"] for r in open_items.class_rules(frame, Mining(0.1, 0.5, 1.0)).collect()}
    assert seen == [2]
    assert got == {("a",): 1.0, ("b",): 0.5, ("a", "b"): 0.5}
