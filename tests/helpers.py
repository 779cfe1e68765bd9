"""Small labelled tables and brute-force answers for them."""

from __future__ import annotations

import random
from itertools import combinations

from ruleweave.contract import FEATURES, LABELS, LABELLED_SCHEMA, RECORD


def frame_of(spark, rows):
    return spark.createDataFrame(rows, LABELLED_SCHEMA)


def constant_rows(value, label, n):
    return [(value,) * 9 + (label,)] * n


def random_rows(n, seed=1):
    """Correlated codes, so that rules of several lengths exist."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        label = rng.choice((-1, -1, 0, 1, 1))
        codes = [label if rng.random() < 0.6 else rng.choice((-1, 0, 1)) for _ in FEATURES]
        rows.append((*codes, label))
    return rows


def items_of(row):
    names = [f"{name}={value}" for name, value in zip(FEATURES, row)]
    return [*names, f"Result={LABELS[row[9]]}"]


def brute_itemsets(rows, min_support, max_len):
    """Support of every itemset up to ``max_len`` items that is frequent."""
    counts = {}
    for row in rows:
        items = sorted(items_of(row))
        for size in range(1, max_len + 1):
            for subset in combinations(items, size):
                counts[subset] = counts.get(subset, 0) + 1
    return {s: c / len(rows) for s, c in counts.items() if c / len(rows) >= min_support}


def brute_rules(rows, min_support, min_confidence, min_lift, max_len):
    """Ranked class rules: longer rules win ties."""
    supports = brute_itemsets(rows, min_support, max_len)
    codes = {label: code for code, label in LABELS.items()}
    rules = []
    for itemset, support in supports.items():
        classes = [i for i in itemset if i.startswith("Result=")]
        antecedent = tuple(i for i in itemset if not i.startswith("Result="))
        if not classes or not antecedent:
            continue
        confidence = support / supports[antecedent]
        lift = confidence / supports[(classes[0],)]
        if confidence >= min_confidence and lift >= min_lift:
            rules.append((antecedent, codes[classes[0][7:]], support, confidence, lift))
    return sorted(rules, key=lambda r: (-r[3], -r[4], -r[2], -len(r[0]), r[1], r[0]))


def brute_generated(rows, min_support, max_len, threshold):
    supports = brute_itemsets(rows, min_support, max_len)
    return sum(
        support / supports[antecedent] >= threshold
        for itemset, support in supports.items()
        for size in range(1, len(itemset))
        for antecedent in combinations(itemset, size)
    )


def record_of(row):
    return dict(zip(RECORD, row))
