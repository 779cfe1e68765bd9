from __future__ import annotations

import random
import re

import pytest
from fixtures import awkward, docs_frame, prose

from ruleweave.llm import near_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for _, t, _ in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 3 * len(a) >= 2 * len(b) and 3 * len(b) >= 2 * len(a):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    home[root(i)] = root(j)
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if sets[i] and root(j) == root(i) and r[0] is not None]
        c = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return out


def same(spark, rows):
    got = [tuple(r) for r in near_copies.link(docs_frame(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    return got


def test_awkward_rows(spark):
    same(spark, awkward())
    assert near_copies.link(docs_frame(spark, [])).count() == 0


def chains():
    """Groups around the threshold: chains of edits, one large family, one passage in many texts."""
    rng = random.Random(8)
    rows, at = [], 0
    for g in range(12):
        words = prose(1000 + g, 120).split()
        for _ in range(8):
            rows.append((at := at + 1, " ".join(words), "a"))
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = f"w{rng.random()}"
    base = prose(77, 90).split()
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"v{rng.random()}"
        rows.append((at := at + 1, " ".join(words), "a"))
    shared = prose(78, 60)
    rows += [(at := at + 1, shared + " " + prose(2000 + i, 30), "b") for i in range(40)]
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_chains(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    got = same(spark, chains())
    assert len({r[2] for r in got}) < len(got)


def test_whole_table(spark, sf_dir):
    same(spark, [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def unlinked(n, seed=91):
    """Texts near to each other that are no links: each changes other words of one text."""
    rng = random.Random(seed)
    base = prose(seed, 160).split()
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(0, 160, 10), 3):
            words[at + 4] = f"u{i}x{at}"
        rows.append((i + 1, " ".join(words), "a"))
    return rows


@pytest.mark.parametrize("block", [512, 9])
def test_near_texts_that_are_no_links_make_no_row_a_pair(spark, monkeypatch, block):
    """What a step makes is bounded by the members of its groups, not by their pairs."""
    made = []

    def counted(step):
        def run(members, *more):
            before = members.count()
            out = near_copies.landed(step(members, *more), "counted")
            made.append((before, out.count()))
            return out

        return run

    monkeypatch.setattr(near_copies, "BLOCK", block)
    for name in ("_touched", "_links"):
        monkeypatch.setattr(near_copies, name, counted(getattr(near_copies, name)))
    rows = unlinked(40) + [(100 + d, t, s) for d, t, s in chains()[:40]]
    same(spark, rows)
    assert made and max(before for before, _ in made) > 0
    assert all(after <= before for before, after in made)
