from __future__ import annotations

import random

import numpy as np
from fixtures import awkward, docs_frame, prose

from ruleweave.llm import decontaminate as D


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")


def brute(text, items):
    """Every window of every item's size, by plain sets."""
    sets = {}
    for i, t in items:
        w = D.words_of(t)
        if w:
            sets[i] = (len(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    n = len(sets)
    held = {}
    for _, s in sets.values():
        for x in s:
            held[x] = held.get(x, 0) + 1
    weigh = lambda s: sum(1 + np.log(n) - np.log(held.get(x, 1)) for x in s)
    w, found = D.words_of(text), {}
    for i, (size, own) in sets.items():
        for at in range(max(1, len(w) - size + 1)):
            part = w[at : at + size]
            kinds = {tuple(part[k : k + 5]) for k in range(max(1, len(part) - 4))} if part else set()
            like = weigh(kinds & own) / weigh(kinds | own) if kinds else 0
            if like >= 0.75 and like > found.get(i, 0):
                found[i] = like
    return found


def test_windows_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(700 + i, rng.randint(18, 50))) for i in range(15)] + [(20, None), (21, ""), (22, "two words"), (23, prose(700, 40))]
    rows = []
    for d in range(60):
        text = prose(9000 + d, rng.randint(5, 60))
        for _ in range(rng.randint(0, 2)):
            words = (items[rng.randrange(15)][1]).upper().split()
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                words[rng.randrange(len(words))] = rng.choice(("changed", "new, words here", ""))
            text += "\n" + " ".join(words) + ". " + prose(rng.randrange(10**6), rng.randint(0, 30))
        rows.append((d, text, "s"))
    rows += [(100, "Two  words", "s"), (101, None, "s")]
    got = {(r.doc_id, r.item_id): r.similarity for r in D.leaks(docs_frame(spark, rows), items_frame(spark, items)).collect()}
    want = {(d, i): s for d, t, _ in rows for i, s in brute(t, items).items()}
    assert len(want) > 20 and set(got) == set(want)
    assert all(got[k] <= want[k] + 1e-5 for k in want)
    clean = {r.doc_id for r in D.clean(docs_frame(spark, rows), items_frame(spark, items)).collect()}
    assert clean == {d for d, _, _ in rows} - {d for d, _ in want}


def test_multi_index_finds_all_within_the_radius():
    index = D.Index([(i, prose(800 + i, 30)) for i in range(60)])
    rng = random.Random(1)
    for n, p in enumerate(index.prints):
        for k in (0, 1, 5, 16, 24):
            near = p
            for b in rng.sample(range(64), k):
                near ^= 1 << b
            assert index.within(near) == {m for m, q in enumerate(index.prints) if (q ^ near).bit_count() <= 24} and n in index.within(near)


def test_awkward_rows(spark):
    rows = awkward()
    items = [(1, prose(1, 60)), (None, prose(2, 90)), (3, None)]
    got = D.leaks(docs_frame(spark, rows), items_frame(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(5, 1), (9, 1), (7, None), (8, None)}
    assert D.leaks(docs_frame(spark, []), items_frame(spark, items)).count() == 0
    assert D.leaks(docs_frame(spark, rows), items_frame(spark, [])).count() == 0
    assert D.clean(docs_frame(spark, rows), items_frame(spark, [])).count() == len(rows)
    assert D.clean(docs_frame(spark, rows), items_frame(spark, items)).columns == docs_frame(spark, rows).columns
