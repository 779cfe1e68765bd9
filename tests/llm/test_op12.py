from __future__ import annotations

import math

import numpy as np
import pytest

from ruleweave.llm import whitening
from ruleweave.llm.eigen import below, leading, leading_values, tridiagonal


def symmetric(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


CASES = {
    "random": symmetric(np.random.default_rng(3).random(50)),
    "one": np.array([[4.0]]),
    "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
    "equal": np.eye(10),
    "zero": np.zeros((6, 6)),
    "rank one": np.ones((7, 7)),
    "cluster": symmetric([9, 9, 9, 9 - 1e-13] + [1.0] * 36),
    "near": symmetric([9, 9 - 1e-9, 8.9999, 8.999] + [1e-9] * 36),
    "tiny": 1e-200 * symmetric(np.arange(40.0)),
    "graded": symmetric(10.0 ** -np.arange(40)),
    "pairs": np.diag(np.abs(np.arange(-10, 11.0))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
}


@pytest.mark.parametrize("name", CASES)
def test_leading_pairs(name):
    a = CASES[name]
    values, rows = leading(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    scale = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * scale
    assert np.abs(a @ rows.T - rows.T * values).max() <= 1e-13 * scale
    assert np.abs(rows @ rows.T - np.eye(len(rows))).max() <= 1e-13


def test_steps_of_the_solver():
    a = CASES["random"]
    diagonal, off, mirrors = tridiagonal(a)
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    assert np.allclose(np.linalg.eigvalsh(t), np.linalg.eigvalsh(a), atol=1e-13)
    q = np.eye(len(a))
    for u in mirrors:
        q = q - 2 * np.outer(q @ u, u)
    assert np.allclose(q @ t @ q.T, a, atol=1e-13)
    points = np.linspace(-0.1, 1.1, 40)
    assert below(diagonal, off, points).tolist() == [int((np.linalg.eigvalsh(a) < p).sum()) for p in points]
    assert np.allclose(leading_values(diagonal, off, 50), np.linalg.eigvalsh(a)[::-1], atol=1e-13)


def brute(vectors, k=4):
    """n, sums, and of every usable row its whitened coordinates, up to the sign of a component."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in good]
    distinct = np.array(sorted({tuple(x) for _, x in xs}), np.int64)
    n, sums = len(distinct), distinct.sum(0)
    centred = distinct - sums / n
    values, rows = np.linalg.eigh(centred.T @ centred / n)
    values, rows = values[::-1][:k], rows.T[::-1][:k]
    out = {}
    for i, x in xs:
        x = np.array(x)
        out.setdefault(i, []).append((int(((n * x - sums) ** 2).sum()), (x - sums / n) @ rows.T / np.sqrt(values)))
    return n, out, values / np.trace(centred.T @ centred / n)


def frame(spark, vectors):
    full = [(i, v, 3, [1.0], 5, 6.5) for i, v in vectors]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, n long, x array<double>, component int, key double")


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 12)) * np.arange(1, 13) / 12 + 2
    vectors = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(base)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(200)]  # a third of the rows are one vector
    vectors += [(7, vectors[7][1]), (None, vectors[3][1]), (2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12)]
    vectors += [(2003, [float("inf")] + [0.0] * 11), (2004, []), (2005, [1.0, 2.0]), (2006, [-0.0] * 12)]
    got = whitening.whiten(frame(spark, vectors).repartition(5), "vec_id", "embedding").collect()
    n, want, explained = brute([v for v in vectors if v[0] not in (2004, 2005)])
    assert sorted({str(r.vec_id) for r in got}) == sorted(map(str, want))
    assert len(got) == 4 * sum(map(len, want.values()))
    signs = {}
    for r in got:
        deviation, y = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, deviation)
        sign = signs.setdefault(r.component, 1 if y[r.component - 1] * r.whitened > 0 else -1)
        assert r.whitened == pytest.approx(sign * y[r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9


def test_given_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding").collect()
    n, want, _ = brute(rows)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    assert {(r.vec_id, r.deviation) for r in got} == {(i, w[0][0]) for i, w in want.items()}
    assert max(abs(abs(r.whitened) - abs(want[r.vec_id][0][1][r.component - 1])) for r in got) < 1e-8


def test_few_dimensions_and_empty(spark):
    def components(vectors):
        return sorted((r.vec_id, r.component) for r in whitening.whiten(frame(spark, vectors), "vec_id", "embedding").collect())

    assert components([]) == [] and components([(1, None)]) == [] and components([(1, [])]) == []
    assert components([(1, [1.0, 2.0])]) == []
    assert components([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [4.0, 2.0])]) == [(1, 1), (2, 1), (3, 1)]
    assert components([(1, [1.0]), (2, [2.0])]) == [(1, 1), (2, 1)]


def test_far_offsets_and_huge_entries(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(1e6 + c)) for c in rng.standard_normal(3)]) for i in range(60)]
    got = whitening.whiten(frame(spark, vectors), "vec_id", "embedding").collect()
    assert got and all(r.identity_error < 1e-4 for r in got)
    assert {(r.vec_id, r.deviation) for r in got} == {(i, w[0][0]) for i, w in brute(vectors)[1].items()}
    huge = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])]), "vec_id", "embedding").collect()
    assert huge and {r.deviation for r in huge if r.vec_id == 1} == {None}
