"""Leading eigenpairs of a symmetric matrix: reflections, bisection, inverse iteration.

The matrix has one row for each dimension of a vector, whatever the number of
vectors, so it is solved on the driver.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Neighbouring eigenvalues closer than this part of the largest form a cluster.
CLUSTER = 1e-3
#: Rounds of inverse iteration; two or three are enough from a random start.
ROUNDS = 6


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflectors of the tridiagonal form of a symmetric matrix.

    Row k of the reflectors is the unit vector u of the k-th Householder reflection
    I - 2uu', or zero where the column needs none.
    """
    a = np.array(matrix, float)
    n = len(a)
    mirrors = np.zeros((max(n - 2, 0), n))
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if length == 0 or np.linalg.norm(x[1:]) == 0:
            continue
        u = x.copy()
        u[0] += np.copysign(length, x[0])  # without cancellation
        u /= np.linalg.norm(u)
        mirrors[k, k + 1 :] = u
        rest = a[k + 1 :, k + 1 :]
        p = 2 * rest @ u
        q = p - (u @ p) * u
        rest -= np.outer(u, q) + np.outer(q, u)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, x[0])
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sturm counts: eigenvalues of the tridiagonal matrix smaller than each point."""
    least = np.finfo(float).tiny + EPS * EPS * (np.abs(off).max(initial=0) ** 2)
    q, count = np.ones(len(points)), np.zeros(len(points), int)
    for d, e in zip(diagonal, np.insert(off, 0, 0)):
        q = d - points - e * e / q
        q = np.where(np.abs(q) < least, -least, q)  # a pivot of zero counts as negative
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection on Sturm counts down to neighbouring doubles."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    span = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))
    low, high = low - EPS * n * span, high + EPS * n * span
    rank = n - 1 - np.arange(k)  # in rising order, from 0
    for _ in range(200):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = below(diagonal, off, middle) > rank  # the eigenvalue lies under the middle
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return (low + high) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - shift) x = right by elimination with row exchanges; pivots of zero become `least`."""
    n = len(diagonal)
    d, up, up2, low, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), np.append(off, 0.0), right.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):  # rows i and i + 1 change places
            d[i], low_i = low[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        else:
            low_i = low[i]
        if abs(d[i]) < least:
            d[i] = least
        factor = low_i / d[i]
        d[i + 1] -= factor * up[i]
        up[i + 1] -= factor * up2[i]
        x[i + 1] -= factor * x[i]
    if abs(d[-1]) < least:
        d[-1] = least
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= up[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= up2[i] * x[i + 2]
        x[i] /= d[i]
    return x


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as rows.

    Vectors of a cluster of close eigenvalues are made orthogonal to each other in
    every round of inverse iteration; equal eigenvalues get some orthonormal basis.
    """
    n = len(matrix)
    k = min(k, n)
    if not k:
        return np.empty(0), np.empty((0, n))
    size = float(np.abs(matrix).max())
    if not size:
        return np.zeros(k), np.eye(n)[:k]
    diagonal, off, mirrors = tridiagonal(np.asarray(matrix) / size)
    values = leading_values(diagonal, off, k)
    scale = max(np.abs(values).max(), np.abs(diagonal).max())
    rng = np.random.default_rng(7)
    vectors = np.empty((k, n))
    start = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * scale:
            start = i
        # equal shifts would give equal solutions but for the reorthogonalisation, so they are moved apart a little
        shift = value - (i - start) * 2 * EPS * scale
        x = rng.standard_normal(n)
        for _ in range(ROUNDS):
            x -= vectors[start:i].T @ (vectors[start:i] @ x)
            x /= np.linalg.norm(x)
            x = _solved(diagonal, off, shift, x, EPS * scale)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= vectors[start:i].T @ (vectors[start:i] @ x)
            x /= np.linalg.norm(x)
        vectors[i] = x
    for u in mirrors[::-1]:
        vectors -= 2 * np.outer(vectors @ u, u)
    return values * size, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
