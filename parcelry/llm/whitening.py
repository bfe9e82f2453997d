"""Operator 13: whitening of embeddings.

Entries become whole numbers ``x = floor(256 c)``.  The model is fitted on the
distinct vectors: their number n, the sums S of each dimension, and the
scatter of the centred vectors ``(n x - S) / n``, whose numerators are exact,
added up block by block inside the tasks.  The scatter (dimensions squared,
whatever the number of rows) goes to the driver, where it is factored by a
Cholesky decomposition with pivoting, stopped where the remaining variance is
rounding; one-sided Jacobi rotations then make the columns of the triangular
factor orthogonal, working on the factor itself.  Squared column norms are
the eigenvalues of the covariance, normalised columns its eigenvectors.  Each
component's sign is fixed by its largest entry, so all rows share it.

``identity_error`` is measured, not assumed: the fit list is whitened, its mean
taken, and the covariance of what is left compared with the identity.

Defined cases: rows whose vector is null or holds a null, infinite or NaN entry
are dropped; null ids, ties and repeated rows are kept (copies count once in
the fit); a vector shorter than the longest has zeros in the missing
dimensions; fewer than four directions with variance give fewer components,
and one distinct vector or an empty table none; other columns are not read.
Entries or sums beyond 64 bits, and more than ``MAX_DIMENSIONS``, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelry.llm.common import release, store

SCALE = 256
MAX_DIMENSIONS = 4096
ROWS_AT_ONCE = 4096
_SAFE = 1 << 62


def whole_numbers(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """``vec_id`` and ``x`` of the rows whose vector is whole and finite."""
    v = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    infinite = float("inf")
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite))
    v = v.filter(F.col("v").isNotNull() & whole)
    limit = float(1 << 63)

    def number(c):
        scaled = F.floor(c * SCALE)
        fits = (c * SCALE >= -limit) & (c * SCALE < limit)
        return F.when(fits, scaled).otherwise(F.raise_error(F.lit("an entry times 256 does not fit 64 bits")).cast("long"))

    return v.select("vec_id", F.transform("v", number).alias("x"))


def padded(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with vectors of one length, and that length."""
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if size > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {size} dimensions; the bound is {MAX_DIMENSIONS}")
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < size, F.concat("x", zeros)).otherwise(F.col("x"))), size


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(lo, ROWS_AT_ONCE)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: 64-bit numbers where they are sure to fit, else Python's."""
    if n * _largest(x) + _largest(sums) < _SAFE:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def deviations(top: np.ndarray) -> np.ndarray:
    """Sum of squares of each row of numerators, exact; an error beyond 64 bits."""
    if top.shape[1] * _largest(top) ** 2 < _SAFE:
        return (top * top).sum(axis=1)
    sums = (top.astype(object) ** 2).sum(axis=1)
    if _largest(sums) >= 1 << 63:
        raise OverflowError("a deviation does not fit 64 bits")
    return sums.astype(np.int64)


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L', L lower trapezoidal of the numerical rank."""
    a = a.copy()
    d = len(a)
    order, factor, rest = np.arange(d), np.zeros((d, d)), np.diag(a).copy()
    floor = d * np.finfo(float).eps * (rest.max() if d else 0.0)
    for k in range(d):
        j = k + int(np.argmax(rest[k:]))
        if rest[j] <= floor:
            return factor[:, :k], order
        for m in (order, rest):
            m[[k, j]] = m[[j, k]]
        factor[[k, j]] = factor[[j, k]]
        a[[k, j]] = a[[j, k]]
        a[:, [k, j]] = a[:, [j, k]]
        factor[k, k] = np.sqrt(rest[k])
        below = slice(k + 1, d)
        factor[below, k] = (a[below, k] - factor[below, :k] @ factor[k, :k]) / factor[k, k]
        rest[below] -= factor[below, k] ** 2
    return factor, order


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of ``n`` (even) columns once, in rounds of disjoint pairs."""
    ring, out = list(range(1, n)), []
    for _ in range(n - 1):
        line = [0, *ring]
        out.append((np.array(line[: n // 2]), np.array(line[: n // 2 - 1 : -1])))
        ring = ring[-1:] + ring[:-1]
    return out


def one_sided_jacobi(columns: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``columns`` rotated in pairs until all are orthogonal."""
    w = columns.copy()
    odd = w.shape[1] % 2
    if odd:
        w = np.hstack([w, np.zeros((len(w), 1))])
    rounds = _rounds(w.shape[1]) if w.shape[1] > 1 else []
    enough = np.finfo(float).eps * max(1, len(w)) ** 0.5
    for _ in range(sweeps):
        worst = 0.0
        for p, q in rounds:
            wp, wq = w[:, p], w[:, q]
            alpha, beta, gamma = (wp * wp).sum(0), (wq * wq).sum(0), (wp * wq).sum(0)
            size = np.sqrt(alpha * beta)
            off = np.abs(gamma) / np.where(size > 0, size, 1)
            worst = max(worst, float(off.max()))
            turn = off > enough
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = np.where(turn, 1 / np.hypot(1, t), 1.0)
            s = np.where(turn, t, 0.0) * c
            w[:, p], w[:, q] = c * wp - s * wq, s * wp + c * wq
        if worst <= enough:
            break
    return w[:, : w.shape[1] - odd]


@dataclass
class Whitening:
    """A fitted model: count, sums, eigenvalues and components (columns), by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def white(self, top: np.ndarray) -> np.ndarray:
        return (top.astype(float) / self.n) @ self.components / np.sqrt(self.values)


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and their unit eigenvectors as columns."""
    factor, order = pivoted_cholesky(covariance)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    by = np.argsort(-norms, kind="stable")
    vectors = np.zeros((len(covariance), len(by)))
    vectors[order] = turned[:, by] / norms[by]
    if len(by):
        vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(by))])
    return norms[by] ** 2, vectors


def _sum_matrix(fit: DataFrame, size: int, shape: tuple[int, int], add) -> np.ndarray:
    """Sum over the fit list of ``add(x)`` (a matrix); each task sends its own sum."""
    rows, columns = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for _, x in _blocks(batches, size):
            total += add(x)
            some = True
        if some:
            i, j = np.divmod(np.arange(rows * columns), columns)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "value"])
        release()

    sums = fit.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros(shape)
    for r in sums.collect():  # rows times columns, whatever the table's size
        out[r.i, r.j] = r.value
    return out


def _count_and_sums(fit: DataFrame, size: int) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, object)
        for part, x in _blocks(batches, size):
            n += part.num_rows
            sums += x.sum(axis=0) if _largest(x) * len(x) < _SAFE else x.astype(object).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([n, *map(int, sums)], pa.int64())], ["i", "value"])
        release()

    found = fit.mapInArrow(run, "i int, value long").groupBy("i").agg(F.sum("value").alias("value"))
    got = {r.i: r.value for r in found.collect()}  # one row a dimension
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(size)], np.int64)


def fit_whitening(rows: DataFrame, size: int, components: int = 4) -> Whitening:
    """The model of the distinct vectors of ``rows`` (``x``, all of length ``size``)."""
    fit = store(rows.select("x").distinct(), "whitening-fit")
    n, sums = _count_and_sums(fit, size)
    none = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)
    if not n or not size:
        return none

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = numerators(x, n, sums).astype(float) / n
        return np.triu(centred.T @ centred)

    upper = _sum_matrix(fit, size, (size, size), scatter) / n
    covariance = upper + np.triu(upper, 1).T
    values, vectors = eigen(covariance)
    k = min(components, len(values))
    model = Whitening(n, sums, values[:k], vectors[:, :k], float(np.trace(covariance)))
    if not k:
        return none
    mean = _sum_matrix(fit, size, (1, k), lambda x: model.white(numerators(x, n, sums)).sum(axis=0, keepdims=True)) / n

    def rest(x: np.ndarray) -> np.ndarray:
        centred = model.white(numerators(x, n, sums)) - mean
        return centred.T @ centred

    model.identity_error = float(np.abs(_sum_matrix(fit, size, (k, k), rest) / n - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, size: int, model: Whitening) -> DataFrame:
    """One row per vector and component: ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    k = len(model.values)
    share = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, size):
            m = part.num_rows
            if not m or not k:
                continue
            top = numerators(x, model.n, model.sums)
            ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                pa.array(np.repeat(deviations(top), k)), pa.array(model.white(top).ravel()),
                pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        release()

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(vectors: DataFrame) -> DataFrame:
    """The contract's rows: up to four components of every remaining row."""
    rows, size = padded(whole_numbers(vectors))
    return whiten(rows, size, fit_whitening(rows, size))
