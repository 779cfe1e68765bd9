from __future__ import annotations

import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from fixtures import awkward, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import filter_audit, queries

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def failures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def brute(docs, labels):
    """Applies every order of the filters to the documents, one after the other."""
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    seen = {}
    for d, text, _ in docs:
        if d is not None:
            seen[text or ""] = min(d, seen.get(text or "", d))
    rows = [(d, lang or "", failures(text or "") | {"E": d is not None and seen[text or ""] < d}) for d, text, lang in docs]
    out = {}
    for part in {p for _, p, _ in rows}:
        own, made, shapley = [r for r in rows if r[1] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[2][f]]
                before, left = left, [r for r in left if not r[2][f]]
                redundant = sum(r[2][f] for r in own) - len(gone)
                alone = sum(r[2][f] and sum(r[2].values()) == 1 for r in own)
                lost = [sum(r[0] in some for r in gone if r[0] is not None) for some in (good, toxic)]
                shapley[f] += len(gone)
                made.append((part, "".join(order), step, len(left), len(gone), redundant, alone, *lost, f))
        out |= {m[:3]: (*m[3:9], shapley[m[9]]) for m in made}
    return sorted((*k, *v) for k, v in out.items())


def frames(spark, docs, labels):
    full = [(d, t, lang, "s", 1, 2, 3, "x") for d, t, lang in docs]
    names = "doc_id long, text string, lang string, source string, n long, failed long, good long, digest string"
    return spark.createDataFrame(full, names), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select(COLUMNS).collect())


def tables():
    long = prose(7, 400)
    docs = [(d, t, lang) for d, t, lang in awkward()]
    docs += [(100, long, "en"), (101, long + "!", "en"), (102, "A" + long, "de"), (103, long.upper(), "de"), (104, long + " #", None)]
    docs += [(d, long, "en" if d % 3 else None) for d in range(200, 230)]  # copies
    docs += [(200, long, "de"), (100, long, "de"), (99, "x", "en"), (98, "x", "fr")]  # repeated ids
    labels = [(d, d % 2, d % 5 == 0) for d in range(95, 230, 3)] + [(100, 1, 0), (100, 0, 1), (100, None, None), (None, 1, 1), (9999, 1, 1)]
    return docs, [(d, q, None if t is None else int(t)) for d, q, t in labels]


def test_against_brute_force(spark):
    docs, labels = tables()
    want = brute(docs, labels)
    assert rows_of(filter_audit.audit(*[f.repartition(3) for f in frames(spark, docs, labels)])) == want
    assert len(want) == 600 * len({p for p, *_ in want})


def test_sql_says_the_same(spark):
    docs, labels = tables()
    con = duckdb.connect()
    for name, frame in zip(("documents", "labels"), frames(spark, docs, labels)):
        con.register(f"{name}_table", frame.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_table")
    found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.SQL['op13_filter_survival_words']})").fetchall()
    assert sorted(found) == brute(docs, labels)


def test_registered(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.SQL['op13_filter_survival_words']})").fetchall()
    assert rows_of(queries.op13_filter_survival_words(spark, sf_dir)) == sorted(want)


@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 1000)), max_size=200))
@settings(max_examples=200, deadline=None)
def test_positional_counts(rows):
    words, times = np.array([w for w, _ in rows], np.uint32), np.array([t for _, t in rows], np.int64)
    assert filter_audit.positional_counts(words, times).tolist() == [sum(t for w, t in rows if w >> b & 1) for b in range(32)]
    assert filter_audit.positional_counts(words).tolist() == [sum(w >> b & 1 for w, _ in rows) for b in range(32)]


def test_empty_and_missing(spark):
    assert rows_of(filter_audit.audit(*frames(spark, [], []))) == []
    lone = [(None, None, None), (1, None, None)]
    assert rows_of(filter_audit.audit(*frames(spark, lone, [(None, 1, 1)]))) == brute(lone, [])


@pytest.mark.parametrize("text", ["", "a " * 199, "a b " * 100, "\x1c\x85 x", "Ünïcode É", "x" * 3_000_000, "w " * 500_000 + "|"])
def test_text_failures(text):
    want = failures(text)
    assert filter_audit.text_failures(text) == sum(want[f] << i for i, f in enumerate("ABCD"))
