"""Whitening of embeddings by a covariance recovered through polarisation.

Vectors become whole numbers x = floor(scale * c), and each distinct x counts once. A covariance is a difference of
variances, cov(a, b) = (var(a + b) - var(a) - var(b)) / 2, so all that is aggregated are squares of centred values: one
sum for every dimension and one for every sum of two dimensions. Values are centred on the whole part of the mean, in
which squares stay small; the fraction of the mean that is left is taken off exactly at the end. Everything up to
the covariance is whole numbers, so results do not depend on partitions or their order. Only the covariance
matrix (dimension x dimension) comes to the driver, for ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.session import stored

SCALE = 256
ROWS = 1024  # vectors whose squares are summed at once
SAFE = 1 << 25  # centred values below this keep the sums of a slice within 64 bits
LONG = 1 << 63
MAX_DIMENSIONS = 4096  # of the matrix at the driver
TASKS = 4096  # at most that add up squares: each sends one row for every two dimensions
LIMB = 10**18  # whole numbers of any size travel as three longs


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds neither nulls nor non-finite entries."""
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def whole(vector: Column, dimensions: int) -> Column:
    """The vector as whole numbers, filled up with zeros to ``dimensions``."""
    numbers = F.transform(vector.cast("array<double>"), lambda c: F.floor(F.lit(float(SCALE)) * c))
    return F.when(F.size(vector) < dimensions, F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), F.lit(dimensions) - F.size(vector)))).otherwise(numbers)


def _matrices(batches: Iterator[pa.RecordBatch], column: int, centre: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows with their centred numbers; Python's integers where 64 bits could overflow."""
    low, high = min(centre, default=0), max(centre, default=0)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, len(centre))
            small = -SAFE < int(x.min(initial=0)) - high and int(x.max(initial=0)) - low < SAFE
            yield part, x - np.array(centre, np.int64) if small else x.astype(object) - np.array(centre, object)


def _totals(z: np.ndarray) -> list[int]:
    return [int(v) for v in z.sum(axis=0)]


def _sums(vectors: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Number of ``vectors`` (x) and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimensions
        for _, x in _matrices(batches, 0, [0] * dimensions):
            n, total = n + len(x), [a + b for a, b in zip(total, _totals(x))]
        yield _entries([-1, *range(dimensions)], [0] * (dimensions + 1), [n, *total])

    found = {i: v for (i, _), v in _added(vectors, run).items()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dimensions)]


def _entries(i: list[int], j: list[int], total: list[int]) -> pa.RecordBatch:
    limbs = [[v % LIMB for v in total], [v // LIMB % LIMB for v in total], [v // LIMB**2 for v in total]]
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(x, pa.int64()) for x in limbs]], ["i", "j", "low", "mid", "high"])


def _added(vectors: DataFrame, run) -> dict[tuple[int, int], int]:
    """Totals of the entries (i, j) that ``run`` makes of each partition."""
    rows = vectors.coalesce(TASKS).mapInArrow(run, "i int, j int, low long, mid long, high long")
    limbs = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("low", "mid", "high")]
    return {(r.i, r.j): int(r.low) + LIMB * int(r.mid) + LIMB**2 * int(r.high) for r in rows.groupBy("i", "j").agg(*limbs).toLocalIterator()}


def _squares(vectors: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of squares of each centred dimension (i, i) and of each sum of two (i, j)."""
    dimensions = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[0] * (dimensions - i) for i in range(dimensions)]
        for _, z in _matrices(batches, 0, centre):
            for i in range(dimensions):
                both = z[:, i:] + z[:, i : i + 1]
                both[:, 0] = z[:, i]
                held[i] = [a + b for a, b in zip(held[i], _totals(both * both))]
        for i in range(dimensions):
            yield _entries([i] * (dimensions - i), list(range(i, dimensions)), held[i])

    return _added(vectors, run)


def covariances(n: int, sums: list[int], squares: dict[tuple[int, int], int]) -> list[list[int]]:
    """n * n times the covariance matrix, from sums and squares of centred values."""
    spread = {(i, j): n * q - (sums[i] if i == j else sums[i] + sums[j]) ** 2 for (i, j), q in squares.items()}  # n * n * variance
    size = range(len(sums))
    return [[spread[i, i] if i == j else (spread[min(i, j), max(i, j)] - spread[i, i] - spread[j, j]) // 2 for j in size] for i in size]


@dataclass(frozen=True)
class Whitener:
    """What is learned of the distinct vectors."""

    n: int
    centre: list[int]  # whole part of each mean
    rest: list[int]  # n * mean - n * centre
    values: np.ndarray  # falling eigenvalues of the covariance of x
    directions: np.ndarray  # their unit eigenvectors, as columns
    explained: np.ndarray
    error: float | None = None

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened values of centred whole vectors; NaN for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (z.astype(np.float64) - np.array([float(Fraction(r, self.n)) for r in self.rest])) @ self.directions / np.sqrt(self.values)
        out[:, ~(self.values > 0)] = np.nan
        return out


def fit(vectors: DataFrame, dimensions: int, components: int) -> Whitener | None:
    """Learned from the distinct ``vectors`` (x: array<long> of ``dimensions``); None if there are none."""
    n, total = _sums(vectors, dimensions)
    if not n:
        return None
    centre = [s // n for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    exact = covariances(n, rest, _squares(vectors, centre))
    trace = sum(exact[i][i] for i in range(dimensions))
    values, directions = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in exact], np.float64).reshape(dimensions, dimensions))
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    noise = dimensions * np.finfo(np.float64).eps * (values[0] if len(values) else 0)
    values = np.where(values > noise, values, 0.0)
    found = Whitener(n, centre, rest, values, np.ascontiguousarray(directions), values / (trace / (n * n)) if trace else np.full(len(values), np.nan))
    return Whitener(n, centre, rest, values, found.directions, found.explained, _identity_error(vectors, found))


def _identity_error(vectors: DataFrame, model: Whitener) -> float | None:
    """Largest entry of |covariance of the whitened vectors - identity|, over components with variance."""
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(len(live)), np.zeros((len(live), len(live)))
        for _, z in _matrices(batches, 0, model.centre):
            w = model.project(z)[:, live]
            first, second = first + w.sum(0), second + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(live) * (len(live) + 1))), pa.array(np.concatenate([first, second.ravel()]))], ["k", "total"])

    rows = vectors.mapInArrow(run, "k long, total double").groupBy("k").agg(F.sum("total").alias("total")).orderBy("k").collect()
    sums = np.array([r.total for r in rows]) / model.n
    mean, product = sums[: len(live)], sums[len(live) :].reshape(len(live), len(live))
    return float(np.abs(product - np.outer(mean, mean) - np.eye(len(live))).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _scored(model: Whitener):
    components, dimensions = len(model.values), len(model.centre)
    rest = model.rest

    def deviations(z: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - sum)^2; None beyond 64 bits."""
        most = max(abs(int(z.min(initial=0))), abs(int(z.max(initial=0))))
        if dimensions * (model.n * (most + 1)) ** 2 < LONG:
            return ((model.n * z - np.array(rest, np.int64)) ** 2).sum(1).astype(np.int64).tolist()
        exact = (model.n * z.astype(object) - np.array(rest, object)) ** 2
        return [v if v < LONG else None for v in (int(row.sum()) for row in exact)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, z in _matrices(batches, 1, model.centre):
            times = lambda values, kind: pa.array([v for v in values for _ in range(components)], kind)
            whitened = model.project(z).ravel()
            n = len(whitened)
            yield pa.RecordBatch.from_arrays(
                [
                    times(part.column(0).to_pylist(), pa.int64()),
                    pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(z))),
                    pa.array(np.full(n, model.n)),
                    times(deviations(z), pa.int64()),
                    pa.array(whitened, mask=np.isnan(whitened)),
                    pa.array(np.tile(model.explained, len(z)), mask=np.isnan(np.tile(model.explained, len(z)))),
                    pa.array([model.error] * n, pa.float64()),
                ],
                [c.split(" ")[0] for c in OUT.split(", ")],
            )

    return run


def whiten(table: DataFrame, components: int = 4, vector: str = "embedding") -> DataFrame:
    """The first ``components`` whitened components of each row of ``table`` (vec_id and the vector column).

    Columns: vec_id, component (from 1, by falling variance), n (distinct vectors), deviation (sum over dimensions of (n * x -
    sum)^2; null if it leaves 64 bits), whitened, explained (share of the variance), identity_error (largest entry of the
    whitened covariance less the identity, measured over the distinct vectors).

    Rows whose vector is null or holds null or non-finite entries are left out; zero vectors stay. Shorter vectors are
    filled up with zeros to the longest; empty ones are such vectors too. Numbers beyond 64 bits become the largest. A
    component without variance has a null ``whitened`` and counts for nothing in ``identity_error``; without
    any variance ``explained`` is null. Fewer dimensions than components give one row per dimension, tables
    without a dimension none. Repeated rows are all returned and count once for the fit. A null vec_id stays null, other
    columns are left out. Equal eigenvalues may come in any order.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(finite(F.col("v")))
    dimensions = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if dimensions > MAX_DIMENSIONS:
        raise ValueError(f"vectors of more than {MAX_DIMENSIONS} dimensions have no covariance matrix at the driver")
    rows = rows.select("vec_id", whole(F.col("v"), dimensions).alias("x"))
    model = fit(stored(rows.select("x").distinct(), "vectors"), dimensions, components) if dimensions else None
    if model is None:
        return table.sparkSession.createDataFrame([], OUT)
    return rows.mapInArrow(_scored(model), OUT)
