"""Whitening of embeddings: principal components of the whole table, from its covariance.

Tasks add up whole-number sums per dimension, then centred products; only dimension-wide
rows are shuffled.  The covariance, dimensions squared and at most MAX_DIMS wide, is
brought to tridiagonal form by Householder reflections; bisection on Sturm counts gives
the leading eigenvalues; inverse iteration gives their vectors, made orthogonal within a
cluster of close eigenvalues, and the reflections turn them back.  Every row is then
projected in its task.

Defined results: vectors that are null, empty, hold null or non-finite entries or whole
numbers beyond 2^53, or whose length isn't the most common one (ties: the shortest) are
no rows of the result; a null vec_id is carried along; repeated rows are rows of their
own; an empty table gives no rows; components without variance (an eigenvalue of nothing
but rounding) are left out; a deviation beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.stage import staged

# Fixed values of the contract.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32

MAX_DIMS = 4096
CLOSE = 1e-3  # of the largest eigenvalue: neighbours nearer than this are one cluster
_ROUNDS = 6


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, x: whole numbers of the vectors that take part, all of one length."""
    v = F.col("v")
    largest = F.lit(float(1 << 53))
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < largest))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(fine)
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    rows = rows.select("vec_id", x.alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == F.lit(common.d if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def dimension_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                # halves of 32 bits: their sums over a batch fit 64 bits
                low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
                sums = [pa.array(a) for a in (np.arange(x.shape[1], dtype=np.int32), np.full(x.shape[1], len(x)), low, high)]
                yield pa.RecordBatch.from_arrays(sums, names=["dim", "n", "low", "high"])

    parts = rows.select("x").mapInArrow(run, "dim int, n long, low long, high long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), whole("low"), whole("high")).orderBy("dim").collect()
    if not found:
        return 0, []
    if len(found) > MAX_DIMS:
        raise ValueError(f"vectors of {len(found)} dimensions; whitening is for {MAX_DIMS} at most")
    return found[0].n, [int(r.low) + (int(r.high) << 32) for r in found]


class Centre:
    """The mean as a whole number and a remainder, so that centring loses nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], object)
        self.part = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, in whole numbers."""
        near = x - self.base
        top = int(np.abs(near).max(initial=0)) + 1
        if (self.n * top) ** 2 * x.shape[1] < 1 << 63:
            gap = near * self.n - self.rest.astype(np.int64)
            return (gap * gap).sum(1).tolist()
        gap = near.astype(object) * self.n - self.rest
        return [d if d < 1 << 63 else None for d in (gap * gap).sum(1).tolist()]


def product_sums(rows: DataFrame, of) -> np.ndarray:
    """Sum over the rows of the outer products of ``of(x)``: each task adds up its own,
    then rows of those matrices are added up by their number."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = of(matrix(batch.column(0)))
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            yield as_rows(total, np.arange(len(total), dtype=np.int32))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), matrix(batch.column(1)) if batch.num_rows else ()):
                totals[i] = totals.get(i, 0) + row
        if totals:
            yield as_rows(np.stack(list(totals.values())), np.array(list(totals), np.int32))

    def as_rows(m: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(number), pa.ListArray.from_arrays(ends, pa.array(m.ravel()))], names=["i", "row"])

    schema = "i int, row array<double>"
    found = rows.select("x").mapInArrow(own, schema).repartition("i").mapInArrow(add, schema).toArrow().sort_by("i")
    return matrix(found.column("row").combine_chunks())


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit normals of the Householder reflections."""
    a, d, normals = v.copy(), len(v), []
    for k in range(d - 2):
        u = a[k + 1 :, k].copy()
        length = np.linalg.norm(u)
        if length:
            u[0] += np.copysign(length, u[0])
            u /= np.linalg.norm(u)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ u
            p -= u * (u @ p)
            rest -= 2 * (np.outer(u, p) + np.outer(p, u))
            # the column itself becomes one number
            a[k + 1, k] = a[k, k + 1] = -np.copysign(length, a[k + 1, k])
        normals.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), normals


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are below each of ``at``."""
    tiny = np.finfo(float).tiny ** 0.5 + np.finfo(float).eps ** 2 * max(1e-300, np.abs(diagonal).max())
    q, n = diagonal[0] - at, np.zeros(len(at), int)
    for i in range(len(diagonal)):
        if i:
            q = diagonal[i] - at - off[i - 1] ** 2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        n += q < 0
    return n


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection."""
    reach = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    margin = np.finfo(float).eps * max(abs(low[0]), abs(high[0])) * len(diagonal)
    low, high = low - margin, high + margin
    wanted = len(diagonal) - 1 - np.arange(k)  # so many are smaller
    for _ in range(100):
        middle = (low + high) / 2
        larger = below(diagonal, off, middle) > wanted  # the value is under the middle
        high, low = np.where(larger, middle, high), np.where(larger, low, middle)
    return (low + high) / 2


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """Solution of (T - shift) x = b by elimination with row exchanges."""
    n = len(diagonal)
    least = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    main, up, up2, b = diagonal - shift, np.r_[off, 0.0], np.zeros(n), b.copy()
    for i in range(n - 1):
        lower = off[i]
        if abs(lower) > abs(main[i]):  # the next row is the pivot
            f = main[i] / lower
            next_main, next_up = main[i + 1], up[i + 1]
            main[i + 1], up[i + 1] = up[i] - f * next_main, -f * next_up
            main[i], up[i], up2[i] = lower, next_main, next_up
            b[i], b[i + 1] = b[i + 1], b[i] - f * b[i + 1]
        elif lower:
            f = lower / main[i]
            main[i + 1] -= f * up[i]
            b[i + 1] -= f * b[i]
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        right = b[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = right / (main[i] if abs(main[i]) > least else np.copysign(least, main[i]))
        if abs(x[i]) > 1e150:  # only the direction counts
            x *= 1e-150
            b *= 1e-150
    return x


def leading_components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as
    columns; at most ``most``, without those that are nothing but rounding."""
    diagonal, off, normals = tridiagonal(v)
    k = min(most, len(v))
    values = leading_values(diagonal, off, k)
    values = values[values > 16 * len(v) * np.finfo(float).eps * max(values[0], 0.0)]
    if not len(values):
        return values, np.zeros((len(v), 0))
    rng, found, first = np.random.default_rng(13), np.zeros((len(v), len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * values[0]:
            first = j
        cluster = found[:, first:j]
        # equal values get slightly parted shifts, so that the solutions differ
        shift = value - (j - first) * np.finfo(float).eps * values[0]
        x = rng.normal(size=len(v))
        for _ in range(_ROUNDS):
            for _ in range(2):
                x -= cluster @ (cluster.T @ x)
            x = solve_shifted(diagonal, off, shift, x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
        for _ in range(2):
            x -= cluster @ (cluster.T @ x)
            x /= np.linalg.norm(x)
        found[:, j] = x
    for at in range(len(normals) - 1, -1, -1):
        u = normals[at]
        if u.any():
            found[at + 1 :] -= 2 * np.outer(u, u @ found[at + 1 :])
    # turned back, each value is taken anew from its vector
    return np.einsum("ij,ij->j", found, v @ found), found


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = staged(whole_vectors(vectors))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums = dimension_sums(rows)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    centre = Centre(n, sums)
    covariance = product_sums(rows, centre) / n
    values, axes = leading_components((covariance + covariance.T) / 2, components)
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    turn, explained = axes / np.sqrt(values), values / np.trace(covariance)

    def with_one(x: np.ndarray) -> np.ndarray:
        y = centre(x) @ turn
        return np.concatenate([y, np.ones((len(y), 1))], axis=1)

    second = product_sums(rows, with_one) / n
    mean = second[-1, :-1]
    error = float(np.abs(second[:-1, :-1] - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(1, k + 1, dtype=np.int32)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch.column(1))
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).take(each), pa.array(np.tile(number, m)), pa.array(np.full(m * k, n)),
                pa.array(centre.deviations(x), pa.int64()).take(each), pa.array((centre(x) @ turn).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
