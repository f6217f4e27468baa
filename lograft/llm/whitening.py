"""Embeddings whitened: projected on the leading eigenvectors of their covariance, variance one.

Spark adds up the mean and then the centred covariance; its eigenvalues and vectors are found on the
driver, as the matrix has as many rows as a vector has components, however many vectors there are:
reflections make it tridiagonal, counting sign changes brackets the largest eigenvalues, and inverse
iteration finds their vectors. The vectors go to every task, which projects its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import ship

#: A covariance of more dimensions is refused: it would not fit the driver.
MOST_DIMENSIONS = 8192
#: Rows that are worked on at a time, and whole numbers below which a component must stay.
ROWS, SHIFT = 4096, 100_000
_EPS = np.finfo(float).eps


# --- Eigenvalues and vectors of a symmetric matrix -----------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the product of the reflections that make ``matrix`` so."""
    a = np.array(matrix, float)
    n = len(a)
    q = np.eye(n)
    nothing = _EPS * np.max(np.abs(a), initial=0)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size <= nothing:  # no more than what rounding leaves
            a[k + 1 :, k] = a[k, k + 1 :] = 0
            continue
        x[0] += np.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        # The reflected column is known: only its first entry is left.
        below = a[k + 1, k]
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, below)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def counted_below(diagonal: np.ndarray, beside: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``x``: the negative pivots of the shifted matrix."""
    squares = np.concatenate([[0.0], beside**2])
    tiny = np.finfo(float).tiny / _EPS
    pivot = np.ones_like(x)
    count = np.zeros(len(x), int)
    for d, s in zip(diagonal, squares, strict=True):
        pivot = d - x - s / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bracketed until no number is left between."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(beside)
    reach[1:] += np.abs(beside)
    edge = max(np.max(np.abs(diagonal) + reach), np.finfo(float).tiny) * (1 + 4 * _EPS)
    low, high = np.full(k, -edge), np.full(k, edge)
    rank = n - 1 - np.arange(k)  # so many eigenvalues are smaller
    for _ in range(200):
        middle = (low + high) / 2
        over = counted_below(diagonal, beside, middle) > rank
        high, low = np.where(over, middle, high), np.where(over, low, middle)
        if np.all(high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))):
            break
    return (low + high) / 2


def _solved(diagonal: np.ndarray, beside: np.ndarray, x: float, right: np.ndarray) -> np.ndarray:
    """Solve (T - x) y = right by elimination with row exchange; a zero pivot becomes tiny."""
    n = len(diagonal)
    scale = max(np.max(np.abs(diagonal)), np.max(np.abs(beside), initial=0), np.finfo(float).tiny)
    main, upper = (diagonal - x).tolist(), [*beside.tolist(), 0.0]
    second, under, y = [0.0] * n, [*beside.tolist(), 0.0], right.tolist()
    for i in range(n - 1):
        if abs(under[i]) > abs(main[i]):
            main[i], under[i] = under[i], main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        if main[i] == 0.0:
            main[i] = _EPS * scale
        m = under[i] / main[i]
        main[i + 1] -= m * upper[i]
        upper[i + 1] -= m * second[i]
        y[i + 1] -= m * y[i]
    for i in range(n - 1, -1, -1):
        if abs(main[i]) < _EPS * scale:
            main[i] = float(np.copysign(_EPS * scale, main[i]))
        y[i] -= upper[i] * y[i + 1] if i + 1 < n else 0.0
        y[i] -= second[i] * y[i + 2] if i + 2 < n else 0.0
        y[i] /= main[i]
    return np.array(y)


def leading_vectors(
    diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray
) -> np.ndarray:
    """A unit vector per eigenvalue, as columns, by inverse iteration from a fixed start.

    Eigenvalues closer than a thousandth of the matrix's size make a cluster: a vector is made
    orthogonal to those found in its cluster after every step, and shifts are kept apart.
    """
    n, k = len(diagonal), len(values)
    size = max(np.max(np.abs(diagonal)), np.max(np.abs(beside), initial=0), np.finfo(float).tiny)
    found = np.zeros((n, k))
    # A start that no eigenvector of a real matrix is likely to be orthogonal to; fixed.
    start = 1 + np.modf(np.arange(1, n + 1) * 0.6180339887498949)[0]
    cluster, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * size:
            cluster = j
        shift = min(value, shift - 10 * _EPS * size)
        near = found[:, cluster:j]
        y = start * np.where((np.arange(n) >> (j - cluster) % 8) & 1, -1, 1)
        for _ in range(6):
            y = _solved(diagonal, beside, shift, y)
            for _ in range(3):
                y = y / max(np.linalg.norm(y), np.finfo(float).tiny)
                y = y - near @ (near.T @ y)
        y /= np.linalg.norm(y)
        found[:, j] = y
    return found


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors."""
    size = np.max(np.abs(matrix), initial=0)
    k = min(k, len(matrix))
    if size == 0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, beside, q = tridiagonal(matrix / size)
    values = leading_values(diagonal, beside, k)
    vectors = q @ leading_vectors(diagonal, beside, values)
    return values * size, vectors / np.linalg.norm(vectors, axis=0)


# --- Sums over all vectors -----------------------------------------------------------------------


def _whole(column, dimensions: int, scale: int) -> np.ndarray:
    """The vectors' components as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(-1, dimensions)
    return np.floor(scale * rows).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int, scale: int, place: int):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, _whole(part.column(place), dimensions, scale)


def _added(
    vectors: DataFrame, measure: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: str
) -> np.ndarray:
    """``measure`` of each task's rows, an array of numbers, added up place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = measure(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)],
                names=["place", "x"],
            )

    parts = vectors.mapInArrow(run, f"place bigint, x {kind}")
    rows = parts.groupBy("place").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows), np.int64 if kind == "bigint" else np.float64)
    for place, x in rows:
        out[place] = x
    return out


class Whitening(NamedTuple):
    """What the fit found: whole-number sums, eigenvalues and vectors, trace and proof."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float


def usable_vectors(
    frame: DataFrame, id_col: str, vector_col: str, scale: int
) -> tuple[DataFrame, int]:
    """``id, v`` of the rows that take part, and their number of dimensions.

    A row takes part unless its vector is null, has a null or non-finite component, or has another
    length than most vectors have (of equally frequent lengths the smallest counts; 0 never).
    """
    v = frame[vector_col].cast("array<double>")
    fine = F.forall(
        v,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        & (F.abs(x) * scale < float(1 << 52)),
    )
    read = frame.select(frame[id_col].alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    sizes = read.groupBy(F.size("v").alias("d")).count().where("d > 0")
    most = sizes.orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; at most {MOST_DIMENSIONS} can be whitened")
    return read.where(F.size("v") == d), d


def fit_whitening(vectors: DataFrame, dimensions: int, k: int, scale: int) -> Whitening:
    """The whitening of all rows of ``usable_vectors``: three passes of sums."""
    d = dimensions

    def sums(batches):
        total = np.zeros(d + 1, np.int64)
        for _, x in _blocks(batches, d, scale, 0):
            total[0] += len(x)
            total[1:] += x.sum(axis=0)
        return total

    only = vectors.select("v")
    found = _added(only, sums, "bigint") if d else np.zeros(1, np.int64)
    if not len(found) or not found[0]:
        return Whitening(0, np.zeros(d, np.int64), np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    n, s = int(found[0]), found[1:]
    mean = np.array([int(x) / n for x in s])

    def covariance(batches):
        total = np.zeros((d, d))
        for _, x in _blocks(batches, d, scale, 0):
            centred = x - mean
            total += centred.T @ centred
        return total.ravel()

    matrix = _added(only, covariance, "double").reshape(d, d) / n
    matrix = (matrix + matrix.T) / 2
    values, vectors_ = leading_pairs(matrix, k)
    trace = float(np.trace(matrix))
    # A direction without variance cannot be scaled to variance one.
    flat = values <= trace * d * _EPS
    with np.errstate(divide="ignore", invalid="ignore"):
        axes = np.where(flat, np.nan, vectors_ / np.sqrt(np.maximum(values, 0)))
    live = int((~flat).sum())
    error = 0.0
    if live:
        lead = axes[:, :live]

        def moments(batches):
            total = np.zeros((live + 1, live))
            for _, x in _blocks(batches, d, scale, 0):
                w = (x - mean) @ lead
                total[0] += w.sum(axis=0)
                total[1:] += w.T @ w
            return total.ravel()

        found = _added(only, moments, "double").reshape(live + 1, live) / n
        error = float(np.max(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(live))))
    return Whitening(n, s, values, axes, trace, error)


_LARGEST = float(np.iinfo(np.int64).max)


def _deviations(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """Sums of squares of n x - S, exact; an error where one is beyond a long."""
    spread = float(np.max(np.abs(x.astype(float) * n - s.astype(float)), initial=0))
    if spread * spread * x.shape[1] < _LARGEST / 2:
        return ((x * n - s) ** 2).sum(axis=1)
    exact = ((x.astype(object) * n - s.astype(object)) ** 2).sum(axis=1)
    if max(exact) > np.iinfo(np.int64).max:
        raise OverflowError("a deviation is beyond a long")
    return exact.astype(np.int64)


def whitened_vectors(
    frame: DataFrame,
    k: int = 8,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector
    and component, from 1 by falling variance, at most ``k`` and as many as there are dimensions.

    A component ``c`` of a vector counts as ``floor(scale * c) + 100000``. ``deviation`` is the
    vector's sum of squares of ``n x - S`` as a whole number, ``whitened`` the centred vector's
    projection over the root of the eigenvalue, ``explained`` the eigenvalue's share of the trace.
    ``identity_error`` is measured on the result: the largest entry by which its covariance is not
    the identity.

    Rows that ``usable_vectors`` leaves out give none; null or repeated identifiers are kept as they
    are. In a direction without variance (equal vectors, fewer vectors than dimensions)
    ``whitened`` is null, and the proof is over the other directions; without any variance
    ``explained`` is null as well. Tables without usable vectors give no rows. A deviation beyond a
    long is an error. Eigenvectors are of either sign, the same for all rows.
    """
    ship(frame.sparkSession)
    vectors, d = usable_vectors(frame, id_col, vector_col, scale)
    fit = fit_whitening(vectors, d, k, scale)
    count, n, s = len(fit.values), fit.n, fit.sums
    mean = np.array([int(x) / n for x in s]) if n else np.zeros(d)
    axes = fit.axes

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not count:
            return
        for part, x in _blocks(batches, d, scale, 1):
            rows = len(x)
            w = ((x - mean) @ axes).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(rows), count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                    pa.array(np.repeat(_deviations(x, n, s), count)),
                    pa.array(w, mask=np.isnan(w)),
                ],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    kind = vectors.schema["id"].dataType.simpleString()
    made = vectors.mapInArrow(
        project, f"vec_id {kind}, component int, deviation bigint, whitened double"
    )
    shares = [float(v) / fit.trace if fit.trace else None for v in fit.values]
    explained = F.lit(None).cast("double")
    if count and fit.trace:
        explained = F.element_at(F.array(*[F.lit(x) for x in shares]), F.col("component"))
    return made.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(fit.identity_error).alias("identity_error"),
    )
