from __future__ import annotations

import hashlib
import random

import pytest
from fixtures import awkward, docs_frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import repeated_spans
from ruleweave.llm.suffix_order import suffix_order


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=500, deadline=None)
def test_suffix_order(text):
    assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_long_runs():
    for text in (b"a" * 3000, b"ab" * 1500, b"aab" * 1000, b"\x00" * 10 + b"z" * 2000):
        assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows):
    first = {}
    for d, t, _ in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t, _ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def same(spark, rows):
    got = [tuple(r) for r in repeated_spans.measure(docs_frame(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    return got


def test_awkward_rows(spark):
    same(spark, awkward())
    assert repeated_spans.measure(docs_frame(spark, [])).count() == 0


def passages():
    rng = random.Random(6)
    pool = [prose(600 + i, 14)[: rng.randint(45, 75)] for i in range(30)] + ["ab" * 40, "x" * 90, "é" * 60, "the " * 30]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice(pool) if rng.random() < 0.6 else prose(rng.randrange(10**6), rng.randint(1, 12)))
            if rng.random() < 0.3:
                cut = rng.choice(pool)
                a = rng.randrange(len(cut))
                parts.append(cut[a:])
        rows.append((rng.choice((d, d, d, 500 - d)), rng.choice(("", " ", "\n")).join(parts), "s"))
    return rows


@pytest.mark.parametrize("settings_", [{}, {"STRETCH": 37, "BATCH": 30, "CELL_BYTES": 100}])
def test_passages(spark, monkeypatch, settings_):
    for name, value in settings_.items():
        monkeypatch.setattr(repeated_spans, name, value)
    got = same(spark, passages())
    assert sum(r[2] for r in got) > 1000


def test_whole_table(spark, sf_dir):
    same(spark, [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_remove(spark):
    passage = prose(9, 30)
    rows = [(1, "start " + passage, "a"), (2, "é" + passage + "é end", "a"), (3, "start " + passage, "a"), (4, None, "a"), (None, passage, "a"), (5, "é" * 40, "a"), (6, "xé" + "é" * 39, "a")]
    out = {r.doc_id: r for r in repeated_spans.remove(docs_frame(spark, rows)).collect()}
    assert set(out) == {1, 2, 4, None, 5, 6} and out[1].text == rows[0][1] and out[None].text == passage
    assert passage not in out[2].text and out[2].text.startswith("é") and out[2].row == 9
    assert out[6].text == "x"
