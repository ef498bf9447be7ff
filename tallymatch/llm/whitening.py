"""Whitening of embeddings, with components from QDWH spectral divide and conquer.

Statistics of all vectors are sums that Spark adds up: number and sums of the distinct vectors, then their centred products.
What reaches the driver is one matrix of dimension by dimension, whatever the number of vectors. There the matrix is split
into invariant subspaces until each is a single component:

* The polar factor of ``A - shift * I`` has eigenvalue 1 where A's eigenvalue is above the shift and -1 where it is below.
  It is found by QDWH, an iteration of at most some six QR or Cholesky decompositions that needs no eigenvalues.
* Half of that factor plus the identity is the projector on the upper subspace. Orthonormal bases of both subspaces
  turn A into two smaller matrices, which are split in the same way. Those that can't hold one of the wanted components
  are left alone.

The components and the mean are broadcast and every vector is projected where it lies.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left out; vectors of different
lengths are an error. Repeated vectors count once for the fit, and every row with one is returned. A component without
variance (fewer distinct vectors than dimensions, a constant entry) has no rows, nor has a table with a single distinct
vector or none. Components of equal variance are in no particular order, the same for all rows. Other columns are not read.
Entries are exact up to 2**44; sums that exceed 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymatch.llm.storage import stored

SCALE = 64
SHIFT = 1_000_000
_EPS = float(np.finfo(float).eps)


# --- QDWH ----------------------------------------------------------------------------------------------------------


def polar(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by the dynamically weighted Halley iteration."""
    n = len(matrix)
    size = np.linalg.norm(matrix)  # not below the largest singular value
    if size == 0:
        return np.eye(n)
    x = matrix / size
    # a lower bound of the smallest singular value: sqrt(n) * |R^-1| is above its inverse
    r = np.linalg.qr(x, mode="r")
    smallest = np.abs(np.diag(r)).min()
    low = _EPS
    if smallest > n * _EPS:
        low = max(low, 1.0 / np.linalg.norm(np.linalg.inv(r)))
    for _ in range(30):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3) if low < 1 else 0.0
        a = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)), 0.0))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
            new = b / c * x + (a - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            factor = np.linalg.cholesky(np.eye(n) + c * (x.T @ x))
            new = b / c * x + (a - b / c) * np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        low = min(low * (a + b * square) / (1 + c * square), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved < (4 * _EPS) ** (1 / 3) and abs(1 - low) < 10 * _EPS ** 0.5:
            break
    # a last Newton-Schulz step brings orthogonality down to rounding
    return 1.5 * x - 0.5 * x @ (x.T @ x)


def _basis(projector: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Orthonormal columns that span a projector's range."""
    rng = np.random.default_rng(seed)
    found, _ = np.linalg.qr(projector @ rng.standard_normal((len(projector), rank)))
    for _ in range(2):
        found, _ = np.linalg.qr(projector @ found)
    return found


def _split(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below some shift; None for a multiple of the identity.

    The mean eigenvalue lies strictly between the least and the largest. Other shifts are tried first, since they divide
    more evenly, and when one hits an eigenvalue.
    """
    n = len(matrix)
    diagonal = np.sort(np.diag(matrix))
    mean = float(np.trace(matrix)) / n
    size = np.linalg.norm(matrix)
    if np.linalg.norm(matrix - mean * np.eye(n)) <= 4 * _EPS * size:
        return None
    best = None
    for shift in (np.median(diagonal), mean, *np.quantile(diagonal, (0.4, 0.6, 0.25, 0.75)), 0.5 * (diagonal[0] + diagonal[-1])):
        sign = polar(matrix - shift * np.eye(n))
        projector = 0.5 * (np.eye(n) + 0.5 * (sign + sign.T))
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        upper = _basis(projector, rank, n)
        # the complement of the upper basis, by the same kind of basis
        lower = _basis(np.eye(n) - upper @ upper.T, n - rank, n + 1)
        lower, _ = np.linalg.qr(lower - upper @ (upper.T @ lower))
        error = np.linalg.norm(upper.T @ matrix @ lower) / size
        if best is None or error < best[0]:
            best = error, upper, lower
        if error < 32 * n * _EPS:
            break
    return None if best is None else best[1:]


def spectral_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n = len(matrix)
    matrix = 0.5 * (matrix + matrix.T)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    # parts above are on top of the stack, so components come out in falling order
    stack: list[tuple[np.ndarray, np.ndarray]] = [(matrix, np.eye(n))]
    while stack and len(values) < wanted:
        part, basis = stack.pop()
        if len(part) == 0:
            continue
        halves = _split(part) if len(part) > 1 else None
        if halves is None:
            for column, value in zip(basis.T, np.diag(part), strict=True):
                values.append(float(value))
                vectors.append(column)
            continue
        for half in reversed(halves):
            inner = half.T @ part @ half
            stack.append((0.5 * (inner + inner.T), basis @ half))
    found = np.array(vectors[:wanted]).T.reshape(n, -1)
    found /= np.linalg.norm(found, axis=0)
    exact = np.einsum("ij,ij->j", found, matrix @ found)
    order = np.argsort(-exact, kind="stable")
    return exact[order], found[:, order]


# --- statistics ----------------------------------------------------------------------------------------------------


def scaled(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of rows with a usable vector; x holds floor(64 * entry) + 1,000,000."""
    entry = F.col(vector)

    def finite(c: Column) -> Column:
        d = c.cast("double")
        return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))

    usable = entry.isNotNull() & (F.size(entry) > 0) & F.forall(entry, lambda c: F.coalesce(finite(c), F.lit(False)))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return embeddings.where(usable).select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dimension)


def _summed(fit: DataFrame, dimension: int, product) -> np.ndarray:
    """Sum of ``product(x)``, a symmetric matrix of the vectors of a batch, over all of ``fit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = product(_matrix(batch.column(0), dimension))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    sums = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (np.asarray(sums[c]) for c in ("i", "j", "v"))
    size = int(j.max()) + 1
    out = np.zeros((size, size))
    out[i, j] = out[j, i] = v
    return out


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: number and sums of the distinct vectors, variances and components, largest variance first."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)**2 in whole numbers."""
        apart = self.n * x - self.sums
        if len(x) and float(np.abs(apart).max()) ** 2 * x.shape[1] >= 2.0**63:
            raise OverflowError("a deviation exceeds 64 bits")
        return (apart * apart).sum(axis=1)


def fitted(vectors: DataFrame, wanted: int) -> Whitening | None:
    """Mean, variances and components of the distinct vectors of ``vectors`` (column x); None without variance."""
    fit = stored(vectors.select("x").distinct())
    shape = fit.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.count("*").alias("n")).first()
    if not shape["n"]:
        return None
    if shape["least"] != shape["most"]:
        raise ValueError(f"vectors of {shape['least']} and of {shape['most']} entries")
    n, dimension = shape["n"], shape["most"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimension, np.int64)
        for batch in batches:
            total += _matrix(batch.column(0), dimension).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension, dtype=np.int32)), pa.array(total)], ["i", "s"])

    # the sum fails on overflow, as it does in Spark's ANSI mode
    by_dimension = fit.mapInArrow(summed, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toArrow()
    sums = np.asarray(by_dimension["s"], np.int64)
    mean = sums / n

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _summed(fit, dimension, products) / n
    trace = float(np.trace(covariance))
    values, components = spectral_components(covariance, min(wanted, dimension))
    real = values > trace * dimension * _EPS
    if not real.any():
        return None
    made = Whitening(n, sums, values[real], components[:, real], trace, 0.0)

    def whitened(x: np.ndarray) -> np.ndarray:
        y = made.project(x)
        return y.T @ y

    identity = _summed(fit, dimension, whitened) / n
    error = float(np.abs(identity - np.eye(len(identity))).max())
    return Whitening(n, sums, made.values, made.vectors, trace, error)


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """A row per usable vector and component: the row's coordinate with variance 1 over the distinct vectors, the share of
    all variance that the component explains, and how far the whitened covariance is from the identity."""
    rows = scaled(embeddings)
    fit = fitted(rows, components)
    spark = embeddings.sparkSession
    if fit is None:
        return spark.createDataFrame([], WHITENED)
    shared = spark.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        k = len(made.values)
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch.column(1), len(made.sums))
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, made.n, np.int64)),
                pa.array(np.repeat(made.deviations(x), k)),
                pa.array(made.project(x).ravel()),
                pa.array(np.tile(made.values / made.trace, m)),
                pa.array(np.full(m * k, made.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in WHITENED.split(", ")])

    return rows.mapInArrow(run, WHITENED)
