"""Whitening of embeddings on their leading components.

Entries become whole numbers, so sums are exact.  Two distributed passes over the
distinct vectors give the mean and the centred covariance; its leading eigenpairs
are found on the driver, and the projection is broadcast to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import landed
from ruleweave.llm.eigen import EPS, leading

STEPS = 256
COMPONENTS = 4
#: Vectors worked on at once inside a task.
ROWS = 4096
#: Tasks that add up the rows of the tasks' covariance sums.
ADDERS = 16


@dataclass
class Whitening:
    """Bounded by the dimension of the vectors: n, exact sums, eigenvalues, unit components as rows, trace, identity error."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def whole(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is complete and finite, with x, its entries in steps of 1/256 as whole numbers.

    A vector is dropped if it is null or holds null or non-finite entries, or if
    its length is not the table's most frequent one (of equally frequent ones the
    longest).  An entry beyond the range of long becomes the nearest long.
    """
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    good = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda c: entry(c.cast("double"))))
    most = good.groupBy(F.size(vector).alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1).collect()
    if most:
        good = good.where(F.size(vector) == most[0]["k"])
    top = float(2**63)

    def step(c):
        scaled = F.floor(c.cast("double") * STEPS)
        far = F.abs(c.cast("double") * STEPS) >= top
        return F.when(far, F.when(c > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))).otherwise(F.when(~far, scaled)).cast("long")

    return good.withColumn("x", F.transform(vector, step))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The vectors of column x as matrices of longs."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            column = batch.column("x").slice(start, ROWS)
            yield column.flatten().to_numpy().reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, None
        for x in _matrices(batches):
            n += len(x)
            # halves of 32 bits, so that no sum leaves the range of long
            part = (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
            totals = part if totals is None else totals + part
        if n:
            yield pa.RecordBatch.from_pydict(
                {"i": list(range(len(totals))), "n": [n] * len(totals), "s": pa.array(map(int, totals), pa.decimal128(38, 0))}
            )

    kinds = "i long, n long, s decimal(38,0)"
    found = fit.mapInArrow(run, kinds).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in found]


def _covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n of the vectors, centred before multiplying."""
    mean = np.array([s / n for s in sums])

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches):
            c = x - mean
            total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": list(range(len(total))), "row": list(total)}, schema=kind)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row")):
                totals[i] = totals.get(i, 0) + np.array(row.as_py())
        if totals:
            yield pa.RecordBatch.from_pydict({"i": list(totals), "row": list(totals.values())}, schema=kind)

    kind = pa.schema([("i", pa.int64()), ("row", pa.list_(pa.float64()))])
    kinds = "i long, row array<double>"
    parts = fit.mapInArrow(squares, kinds).repartition(min(len(sums), ADDERS), "i").mapInArrow(added, kinds)
    matrix = np.array([r["row"] for r in sorted(parts.collect())]) / n
    return (matrix + matrix.T) / 2


def _projector(n: int, sums: list[int], values: np.ndarray, components: np.ndarray):
    """A function from a matrix of x to its whitened rows.

    x minus the whole part of the mean is exact in double, whatever the offset.
    """
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    turn = (components / np.sqrt(values)[:, None]).T
    return lambda x: (x - base - rest) @ turn


def _identity_error(fit: DataFrame, project, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from one pass of centred moments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, squares = 0, np.zeros(k), np.zeros((k, k))
        for x in _matrices(batches):
            y = project(x)
            own = y.mean(0)
            c, gap = y - own, own - mean
            squares += c.T @ c + np.outer(gap, gap) * (n * len(y) / (n + len(y)))
            n += len(y)
            mean += gap * len(y) / n
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean], "squares": [squares.ravel()]})

    parts = fit.mapInArrow(run, "n long, mean array<double>, squares array<double>")
    # centred moments of parts add up with n times the products of their means, which lie near zero
    i, j = F.col("at") / k, F.col("at") % k
    cells = parts.select("n", "mean", F.posexplode("squares").alias("at", "square"))
    cells = cells.select("n", "at", "square", F.get("mean", i.cast("int")).alias("a"), F.get("mean", j.cast("int")).alias("b"))
    sums = cells.groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("square").alias("q"), F.sum(F.col("n") * F.col("a") * F.col("b")).alias("ab"),
        F.sum(F.col("n") * F.col("a")).alias("a"), F.sum(F.col("n") * F.col("b")).alias("b"),
    )
    errors = [
        abs((r["q"] + r["ab"] - r["a"] * r["b"] / r["n"]) / r["n"] - (r["at"] // k == r["at"] % k)) for r in sums.collect()
    ]
    return float(max(errors))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Whitening of the distinct vectors in column x (of equal lengths).

    Components whose eigenvalue is not above the rounding of the trace are left
    out, so vectors that span fewer dimensions have fewer, and a single vector or
    an empty table has none.
    """
    distinct = landed(vectors.select("x").distinct(), "whitening-fit")
    n, sums = _sums(distinct)
    if not n or not sums:
        return Whitening(n, sums, np.empty(0), np.empty((0, 0)), 0.0, 0.0)
    covariance = _covariance(distinct, n, sums)
    trace = float(np.trace(covariance))
    values, rows = leading(covariance, components)
    real = values > 4 * EPS * len(sums) * trace
    values, rows = values[real], rows[real]
    error = _identity_error(distinct, _projector(n, sums, values, rows), len(values)) if len(values) else 0.0
    return Whitening(n, sums, values, rows, trace, error)


def project(vectors: DataFrame, w: Whitening, key: str) -> DataFrame:
    """For every row and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Repeated rows and null keys stay; other columns are ignored.  deviation is
    null where it leaves the range of long.
    """
    k = len(w.values)
    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    keyed = vectors.select(F.col(key).cast("long").alias("key"), "x")
    schema = pa.schema(
        [("key", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
        + [(c, pa.float64()) for c in ("whitened", "explained", "identity_error")]
    )
    if not k:
        return vectors.sparkSession.createDataFrame([], f"{key} long, {kinds}")
    shared = vectors.sparkSession.sparkContext.broadcast(w)  # as large as components times dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        whiten = _projector(w.n, w.sums, w.values, w.components)
        for batch in batches:
            keys, start = batch.column("key"), 0
            for x in _matrices([batch]):
                m = len(x)
                order = pa.array(np.repeat(np.arange(start, start + m), k))
                start += m
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(order),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, w.n)),
                        pa.array(_deviations(x, w.n, w.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(whiten(x).ravel()),
                        pa.array(np.tile(w.values / w.trace, m)),
                        pa.array(np.full(m * k, w.identity_error)),
                    ],
                    schema=schema,
                )

    return keyed.mapInArrow(run, f"key long, {kinds}").withColumnRenamed("key", key)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n*x - S)^2, exactly; None beyond the range of long."""
    far = int(max(x.max(initial=0), -int(x.min(initial=0)))) * n + max(map(abs, sums))
    if far * far * len(sums) < 2**63:
        gap = x * n - np.array(sums, np.int64)
        return (gap * gap).sum(1).tolist()
    totals = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [t if t < 2**63 else None for t in totals]


def whiten(rows: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every row with a usable vector; see `whole`, `fit` and `project`."""
    vectors = whole(rows.select(key, vector), vector)
    return project(vectors, fit(vectors, components), key)
