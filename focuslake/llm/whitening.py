"""Whitening of embeddings by their principal components.

Entries become integers, ``x = floor(64 c) + 1000000``, and the model is fitted to every distinct x once. Counts and sums
are exact; the scatter is summed by the tasks from centred rows, (n x - S) / n with an exact numerator. The driver only
gets matrices of the vectors' dimension. It factors the covariance by Cholesky with pivots, and turns the columns of
the triangular factor against each other (one-sided Jacobi, disjoint pairs at a time) until all are at right angles.
Their squared norms are then the eigenvalues and the columns divided by their norms the components; eigenvectors are
never taken from the covariance itself, so small eigenvalues keep their digits.

Rows take no part whose vector is null or empty, holds a null or a number that is not finite or not below 2^56, or
has another length than most (the longer of two lengths that are equally frequent). A null ``vec_id`` stays and repeated rows are
answered one by one; a vector that fills a third of the table is one row of the fit. Components are numbered by falling
eigenvalue; among equal ones the basis is any that is orthogonal. Their sign makes the largest entry positive. Directions
without variance give no component, so there may be fewer than asked for, and none for one distinct vector or
an empty table. ``deviation`` is null where its exact value passes 63 bits. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder
from .components import stored
from .words import bound_batches

SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 56)   # above, x would not fit in 64 bits
COMPONENTS = 16
MERGED = 32          # matrices at most that reach the driver
SWEEPS = 60
SAFE = 1 << 62
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT)))
    common = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (common["d"] if common else -1))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Whitening:
    """Values, components and what is needed to apply them; ``components`` has one column for each value."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: 64-bit integers where they hold it, else Python's."""
        largest = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums), 0)
        if largest < SAFE // 2:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.lifted(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        z = self.lifted(x)
        if z.dtype != object and z.shape[1] * int(np.abs(z).max(initial=0)) ** 2 < SAFE:
            return (z * z).sum(1).tolist()
        z = z.astype(object)
        return [s if s < 1 << 63 else None for s in (z * z).sum(1)]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def summed(fit: DataFrame, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(rows)`` over all rows in batches: one array per task, added up in MERGED tasks and then here."""

    def total(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = None
        for a in arrays:
            held = a if held is None else held + a
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ravel(held).tolist()], pa.list_(pa.float64()))], names=["a"])

    tasks = fit.mapInArrow(lambda batches: total(of(matrix(b.column(0))) for b in batches if b.num_rows), "a array<double>")
    few = tasks.repartition(MERGED).mapInArrow(lambda batches: total(matrix(b.column(0)).sum(0) for b in batches if b.num_rows), "a array<double>")
    out = np.zeros(int(np.prod(shape)))
    for row in few.collect():
        out += np.array(row.a)
    return out.reshape(shape)


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): ``a[order][:, order] = factor @ factor.T``; columns end where nothing is left."""
    d = len(a)
    a, order, factor = a.copy(), np.arange(d), np.zeros((d, d))
    left = np.diag(a).copy()
    least = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= least:
            return factor[:, :k], order
        swap = [k, p], [p, k]
        order[swap[0]], left[swap[0]], factor[swap[0]] = order[swap[1]], left[swap[1]], factor[swap[1]]
        a[swap[0]] = a[swap[1]]
        a[:, swap[0]] = a[:, swap[1]]
        factor[k, k] = np.sqrt(left[k])
        factor[k + 1:, k] = (a[k + 1:, k] - factor[k + 1:, :k] @ factor[k, :k]) / factor[k, k]
        left[k + 1:] -= factor[k + 1:, k] ** 2
    return factor, order


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns such that each round's are disjoint and every two columns meet once."""
    m = n + n % 2
    seats, out = list(range(m)), []
    for _ in range(m - 1):
        pairs = [(seats[i], seats[m - 1 - i]) for i in range(m // 2)]
        kept = [(min(p), max(p)) for p in pairs if max(p) < n]
        out.append(tuple(np.array(c, int) for c in zip(*kept)) if kept else (np.zeros(0, int),) * 2)
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor's columns, turned until all are at right angles."""
    g, eps = factor.copy(), np.finfo(float).eps
    if g.shape[1] < 2:
        return g
    plan = rounds(g.shape[1])
    for _ in range(SWEEPS):
        turned = 0
        for p, q in plan:
            a, b, c = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            some = np.abs(c) > eps * np.sqrt(a * b) * np.sqrt(len(g))
            if not some.any():
                continue
            turned += int(some.sum())
            p, q, a, b, c = p[some], q[some], a[some], b[some], c[some]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            cos = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = cos * g[:, p] - cos * t * g[:, q], cos * t * g[:, p] + cos * g[:, q]
        if not turned:
            return g
    raise ArithmeticError(f"columns are not at right angles after {SWEEPS} sweeps")


def principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, components): all positive eigenvalues, falling, and their unit eigenvectors as columns."""
    factor, order = pivoted_cholesky(covariance)
    g = one_sided_jacobi(factor)
    norms = np.sqrt((g ** 2).sum(0))
    rank = np.argsort(-norms, kind="stable")
    out = np.empty_like(g)
    out[order] = g[:, rank] / norms[rank]
    if out.size:
        out *= np.where(out[np.abs(out).argmax(0), np.arange(out.shape[1])] < 0, -1.0, 1.0)
    return norms[rank] ** 2, out


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The model of distinct vectors (x), a stored table; null without any."""
    bound_batches(vectors)
    n = vectors.count()
    if not n:
        return None
    sums = vectors.select(F.posexplode("x").alias("i", "value")).groupBy("i").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("s"))
    sums = [int(r.s) for r in sums.orderBy("i").collect()]
    model = Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), np.zeros(0))

    def scatter(x: np.ndarray) -> np.ndarray:
        z = model.centred(x)
        return z.T @ z

    covariance = summed(vectors, (len(sums),) * 2, scatter) / n
    values, components = principal(covariance)
    return Whitening(n, sums, values[:k], components[:, :k], values[:k] / np.trace(covariance))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    mean = summed(vectors, (k,), lambda x: model.apply(x).sum(0)) / model.n

    def scatter(x: np.ndarray) -> np.ndarray:
        z = model.apply(x) - mean
        return z.T @ z

    return float(np.abs(summed(vectors, (k, k), scatter) / model.n - np.eye(k)).max())


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """ROWS: one row for each row of (vec_id, x) and component."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, each = matrix(b.column(1)), np.repeat(np.arange(b.num_rows), k)
            columns = [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                       pa.array(np.full(len(each), model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                       pa.array(model.apply(x).ravel()), pa.array(np.tile(model.explained, b.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return bound_batches(rows).select("vec_id", "x").mapInArrow(run, ROWS)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, folder: str | None = None) -> DataFrame:
    """ROWS and ``identity_error`` for every row that takes part; distinct vectors are stored in ``folder``."""
    spark = vectors.sparkSession
    folder = folder or shared_folder(spark, "whitening")
    rows = usable(vectors, vec_id, vector)
    distinct = stored(rows.select("x").distinct(), f"{folder}/distinct")
    model = fit(distinct, k)
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"{ROWS}, identity_error double")
    return project(rows, model).withColumn("identity_error", F.lit(identity_error(distinct, model)))
