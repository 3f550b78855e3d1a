"""Whitening of embeddings: an exact centred scatter by tasks, its eigenvectors by cyclic Jacobi rotations on the driver.

Entries are whole numbers after quantising, so that sums, products and the covariance are exact in whatever order tasks
end; only its eigenvectors and the whitened values are rounded. The driver holds matrices of the vectors' dimension, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

#: x = floor(SCALE * c) + SHIFT for an entry c.
SCALE, SHIFT = 64.0, 1_000_000
#: Entries of this size or more have no x of 64 bits and count as non-finite.
TOO_LARGE = 2.0**54
COMPONENTS = 32
SWEEPS = 40


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their x as a matrix of 64-bit numbers) for each length of the column's vectors without null, non-finite or too large entries."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
        fit = (np.abs(flat) < TOO_LARGE).all(axis=1)  # null entries are NaN here
        if fit.any():
            yield rows[fit], np.floor(SCALE * flat[fit]).astype(np.int64) + SHIFT


def of_length(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one length."""
    return next(((rows, x) for rows, x in vectors_of(column) if x.shape[1] == dim), (np.empty(0, np.int64), np.empty((0, dim), np.int64)))


def scatter(y: np.ndarray) -> np.ndarray:
    """Sum of the products of all pairs of columns, exact, as Python's whole numbers. Products in doubles are exact while sums stay below 2^53."""
    most = int(np.abs(y).max(initial=0))
    rows = 2**53 // max(1, most * most)
    if rows < 32:
        own = y.astype(object)
        return own.T @ own
    out = np.zeros((y.shape[1],) * 2, object)
    for k in range(0, len(y), rows):
        part = y[k:k + rows].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def matrix_of(parts: DataFrame, total: Callable, kind: Callable) -> dict[tuple[int, int], list]:
    """(dim, line) to the sum of the lines (dim, line, values) that tasks made, values as text; each line is added up in one task, from one line of each task before."""
    def run(table: pa.Table) -> pa.Table:
        columns = zip(*[map(kind, v.split()) for v in table.column("values").to_pylist()], strict=True)
        return pa.table([table.column("dim").slice(0, 1), table.column("line").slice(0, 1), pa.array([" ".join(repr(total(c)) for c in columns)])], ["dim", "line", "values"])

    added = parts.groupBy("dim", "line").applyInArrow(run, "dim int, line int, values string")
    return {(r["dim"], r["line"]): list(map(kind, r["values"].split())) for r in added.collect()}  # a matrix of the vectors' dimension


def lines(dim: int, values: np.ndarray) -> pa.RecordBatch:
    text = [" ".join(repr(v) for v in line) for line in values.tolist()]
    return pa.RecordBatch.from_arrays([pa.array([dim] * len(text), pa.int32()), pa.array(range(len(text)), pa.int32()), pa.array(text, pa.string())], ["dim", "line", "values"])


PART = "dim int, line int, values string"


def totals(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(length, number, sums by dimension) of the vectors of the most frequent length, of ties the longest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for rows, x in vectors_of(b.column(0)):
                dim = x.shape[1]
                low = x.min() if np.abs(x).max() > 2**62 // len(x) else None
                added = x.sum(axis=0).tolist() if low is None else x.astype(object).sum(axis=0).tolist()
                own[dim] = own.get(dim, np.zeros((1, dim + 1), object)) + np.array([[len(rows), *added]], object)
        for dim, line in own.items():
            yield lines(dim, line)

    found = matrix_of(vectors.mapInArrow(run, PART), sum, int)
    (dim, _), (n, *sums) = max(found.items(), key=lambda kv: (kv[1][0], kv[0][0]), default=((0, 0), [0]))
    return dim, n, sums


def covariance(vectors: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of x over all vectors of a length, each entry the double next to the exact value.

    Tasks centre x at the whole numbers next to the means before they multiply; what is left of the means, at most a half, is taken out of the exact sums.
    """
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((dim, dim), object)
        for b in batches:
            own = own + scatter(of_length(b.column(0), dim)[1] - centre)
        yield lines(dim, own)

    found = matrix_of(vectors.mapInArrow(run, PART), sum, int)
    left = [s - n * int(m) for s, m in zip(sums, centre, strict=True)]
    return np.array([[(n * found[dim, i][j] - left[i] * left[j]) / (n * n) for j in range(dim)] for i in range(dim)])


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n indexes, each once, in rounds of pairs without a common index."""
    ring, out = list(range(n + n % 2)), []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) if a < b else (b, a) for a, b in zip(ring[:len(ring) // 2], ring[::-1], strict=False) if max(a, b) < n]
        out.append(tuple(np.array(x, int) for x in zip(*pairs, strict=True)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out if n > 1 else []


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors in columns) of a symmetric matrix by cyclic rotations until every entry off the diagonal vanishes beside its two diagonal ones.

    As that measure is relative to the diagonal, small eigenvalues of a covariance are as accurate as large ones. A sweep visits each pair once,
    pairs without a common index together.
    """
    a, u = matrix.copy(), np.eye(len(matrix))
    tiny = np.finfo(float).tiny
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds(len(a)):
            turn = np.abs(a[p, q]) > np.maximum(1e-15 * np.sqrt(np.abs(a[p, p] * a[q, q])), tiny)
            if not turn.any():
                continue
            turned, p, q = True, p[turn], q[turn]
            off, app, aqq = a[p, q], a[p, p], a[q, q]
            with np.errstate(over="ignore"):
                slope = (aqq - app) / (2 * off)
                t = np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.hypot(1.0, slope))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
            a[p, p], a[q, q], a[p, q], a[q, p] = app - t * off, aqq + t * off, 0.0, 0.0
            u[:, p], u[:, q] = c * u[:, p] - s * u[:, q], s * u[:, p] + c * u[:, q]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], u[:, order]


@dataclass
class Whitening:
    """What turns a vector into whitened components: n vectors of `dim` entries with these sums; eigenvectors in columns, their eigenvalues and the covariance's trace."""

    dim: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def spread(self) -> np.ndarray:
        """Square roots of the eigenvalues; NaN where one is zero beside the largest, as a direction without spread cannot be whitened."""
        least = self.dim * np.finfo(float).eps * max(self.eigenvalues.max(initial=0.0), 0.0)
        return np.sqrt(np.where(self.eigenvalues > least, self.eigenvalues, np.nan))

    def apply(self, x: np.ndarray) -> np.ndarray:
        centre = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        left = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, centre, strict=True)])
        return ((x - centre).astype(np.float64) - left) @ self.components / self.spread

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S)^2, exact; None beyond 64 bits."""
        centre = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        left, y = [s - self.n * int(m) for s, m in zip(self.sums, centre, strict=True)], x - centre
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * self.dim < 2**63:
            return ((self.n * y - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - np.array(left, object)) ** 2).sum(axis=1).tolist()
        return [d if d < 2**63 else None for d in exact]


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all usable vectors, in two passes. Vectors of another length than the most frequent one (of ties the longest) count as holding nulls."""
    only = vectors.select(F.col(vector_col).cast("array<double>").alias("_v"))
    dim, n, sums = totals(only)
    if not n:
        return Whitening(0, 0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    v = covariance(only, dim, n, sums)
    e, u = jacobi(v)
    return Whitening(dim, n, sums, u[:, :components], e[:components], math.fsum(np.diag(v)))


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over components with spread; measured on all vectors, whose whitened means are zero by definition. None without any."""
    some = ~np.isnan(model.spread)
    if not some.any():
        return None
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # dim x components numbers
    size = int(some.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = np.zeros((size, size)), shared.value
        for b in batches:
            w = m.apply(of_length(b.column(0), m.dim)[1])[:, some]
            own += w.T @ w
        yield lines(m.dim, own)

    found = matrix_of(vectors.select(F.col(vector_col).cast("array<double>").alias("_v")).mapInArrow(run, PART), math.fsum, float)
    measured = np.array([found[model.dim, i] for i in range(size)]) / model.n
    return float(np.abs(measured - np.eye(size)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries or ones of 2^54 or more are left out, and so are those of
    another length than the most frequent one (of ties the longest). Ids may be null or repeat; each row counts for itself.
    deviation is null where it exceeds 64 bits. A component without spread, as where all vectors are equal, has a null whitened
    value and no share in identity_error; explained is null where nothing has spread. Columns other than the two named are
    not read. An empty table gives an empty result. The table is read four times: sums, scatter, check and result.
    """
    model = fit(vectors, vector_col, components)
    kinds = [("component", IntegerType()), ("n", LongType()), ("deviation", LongType()), ("whitened", DoubleType()), ("explained", DoubleType()), ("identity_error", DoubleType())]
    schema = StructType([StructField("_id", vectors.schema[id_col].dataType), *[StructField(c, t) for c, t in kinds]])
    error = identity_error(vectors, model, vector_col)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.eigenvalues)
        share = [max(e, 0.0) / m.trace if m.trace > 0 else None for e in m.eigenvalues.tolist()]
        for b in batches:
            rows, x = of_length(b.column(1), m.dim)
            if k and len(rows):
                w = m.apply(x).ravel()
                each = lambda values, kind: pa.array([v for v in values for _ in range(k)], kind)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(w), m.n)),
                     each(m.deviations(x), pa.int64()), pa.array(w, mask=np.isnan(w)), pa.array(share * len(rows), pa.float64()), pa.array([error] * len(w), pa.float64())],
                    schema.names)

    return vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
