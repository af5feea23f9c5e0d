"""Embedding whitening by Welford updates, parallel merges and a symmetric QR eigen-solve (operator 12).

Each partition streams its vectors through Welford's rank-one updates of (count, mean, centred products) and sends one
row; rows are merged by the parallel update formula, first in as many tasks as the session has shuffle partitions, then
in one, which holds two d x d matrices whatever the number of rows. Sums are kept as whole numbers beside the means. The
driver solves the d x d eigenproblem (Householder reduction, then implicitly shifted QR steps) and sends d x 8
numbers back with the projection. The error of the result is measured, not assumed: a second pass gathers the
covariance of the whitened vectors in the same way.

Components whose variance is nought beside the largest (below d * 2**-52 of it) cannot be scaled to one and are left
out, so a single vector, or equal ones, give no rows.

Defined results: vectors that are null, empty, or hold a null, a non-finite entry or one beyond 2**42 are dropped, as
are those of another length than most (of equally frequent lengths, the longest stays); repeated rows each count and
each have their rows; a null id stays null; a deviation that a long cannot hold is null; extra columns are ignored; no
usable vector, no rows. A vector of any length is used whole; a task holds a few d x d matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.llm.common import partitions

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Entries beyond this have no exact whole number after scaling.
LARGEST = float(1 << 42)
_STATE = "n long, mean array<double>, products binary, sums array<string>"


class Moments:
    """Count, mean and centred products of vectors, and their sums as whole numbers."""

    def __init__(self, dims: int):
        self.n, self.mean, self.products, self.sums = 0, np.zeros(dims), np.zeros((dims, dims)), [0] * dims
        self._step = np.zeros((dims, dims))

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update for each row."""
        mean, products, step = self.mean, self.products, self._step
        for row in rows:
            self.n += 1
            apart = row - mean
            mean += apart / self.n
            np.multiply(apart[:, None], apart * ((self.n - 1) / self.n), out=step)
            products += step

    def add_sums(self, rows: np.ndarray) -> None:
        """``rows`` hold whole numbers below 2**53; 512 of them cannot leave 64 bits."""
        for i in range(0, len(rows), 512):
            self.sums = [a + int(b) for a, b in zip(self.sums, rows[i : i + 512].astype(np.int64).sum(axis=0), strict=True)]

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray, sums: list[int]) -> None:
        total = self.n + n
        if n:
            apart = mean - self.mean
            self.products += products + np.outer(apart, apart) * (self.n / total * n)
            self.mean += apart * (n / total)
        self.n, self.sums = total, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"n": self.n, "mean": self.mean.tolist(), "products": self.products.tobytes(), "sums": list(map(str, self.sums))}],
            schema=pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("products", pa.binary()), ("sums", pa.list_(pa.string()))]),
        )


def _merged(dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Moments(dims)
        for batch in batches:
            for i in range(batch.num_rows):
                products = np.frombuffer(batch.column(2)[i].as_buffer(), float).reshape(dims, dims)
                found.merge(batch.column(0)[i].as_py(), np.array(batch.column(1)[i].as_py()), products, list(map(int, batch.column(3)[i].as_py())))
        if found.n:
            yield found.row()

    return run


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def scaled(rows: np.ndarray) -> np.ndarray:
    """The whole numbers of the entries, as doubles."""
    return np.floor(rows * SCALE) + SHIFT


def moments(vectors: DataFrame, dims: int, kernel: Callable | None = None, width: int | None = None) -> Moments:
    """Moments of column ``vector`` (``dims`` entries each), or of what ``kernel`` makes of its scaled rows (``width`` entries)."""
    width = width or dims

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Moments(width)
        for batch in batches:
            rows = scaled(_matrix(batch.column(0), dims))
            if kernel is None:
                found.add_sums(rows)
            found.add(rows if kernel is None else kernel(rows))
        if found.n:
            yield found.row()

    some = vectors.select("vector").mapInArrow(partial, _STATE).repartition(partitions(vectors.sparkSession)).mapInArrow(_merged(width), _STATE)
    last = some.repartition(1).mapInArrow(_merged(width), _STATE).collect()  # one row
    found = Moments(width)
    for row in last:
        found.merge(row.n, np.array(row.mean), np.frombuffer(row.products, float).reshape(width, width), list(map(int, row.sums)))
    return found


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal basis of a symmetric matrix, by Householder reflections."""
    a = matrix.copy()
    n = len(a)
    basis = np.eye(n)
    noise = np.finfo(float).eps ** 2 * np.abs(a).max(initial=0)
    for k in range(n - 2):
        mirror = a[k + 1 :, k].copy()
        if np.abs(mirror[1:]).max() <= noise:  # nothing to reflect, and squares of such entries could underflow
            a[k + 2 :, k] = 0
            continue
        top = -np.copysign(np.linalg.norm(mirror), mirror[0])
        mirror[0] -= top
        mirror /= np.linalg.norm(mirror)
        image = a[k + 1 :, k + 1 :] @ mirror
        image -= (mirror @ image) * mirror
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(mirror, image) + np.outer(image, mirror))
        a[k + 1 :, k] = 0
        a[k + 1, k] = top
        basis[:, k + 1 :] -= 2 * np.outer(basis[:, k + 1 :] @ mirror, mirror)
    return np.diag(a).copy(), np.diag(a, -1).copy(), basis


def _qr_step(d: np.ndarray, e: np.ndarray, columns: np.ndarray, low: int, high: int) -> None:
    """One implicitly shifted QR step on the block low..high; ``columns`` holds the basis vectors as rows."""
    half = (d[high - 1] - d[high]) / 2
    shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
    x, z = d[low] - shift, e[low]
    for k in range(low, high):
        r = np.hypot(x, z)
        c, s = (x / r, z / r) if r else (1.0, 0.0)
        if k > low:
            e[k - 1] = r
        here, after, off = d[k], d[k + 1], e[k]
        d[k] = c * c * here + 2 * c * s * off + s * s * after
        d[k + 1] = s * s * here - 2 * c * s * off + c * c * after
        e[k] = c * s * (after - here) + (c * c - s * s) * off
        if k < high - 1:
            x, z = e[k], s * e[k + 1]
            e[k + 1] *= c
        columns[k : k + 2] = np.array([[c, s], [-s, c]]) @ columns[k : k + 2]


def symmetric_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, their largest entry positive) of a symmetric matrix."""
    d, e, basis = tridiagonal(matrix)
    columns = np.ascontiguousarray(basis.T)
    high = len(d) - 1
    eps, noise = np.finfo(float).eps, np.finfo(float).eps ** 2 * np.abs(matrix).max(initial=0)
    while high > 0:
        small = np.abs(e[:high]) <= np.maximum(eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1])), noise)
        e[:high][small] = 0
        if small[high - 1]:
            high -= 1
            continue
        low = int(np.flatnonzero(small)[-1]) + 1 if small.any() else 0
        _qr_step(d, e, columns, low, high)
    order = np.argsort(-d, kind="stable")
    found = columns[order]
    signs = np.sign(found[np.arange(len(d)), np.abs(found).argmax(axis=1)])
    return d[order], (found * signs[:, None]).T


@dataclass
class Whitening:
    """What ``fit`` learns: n, the exact sums, the leading variances and directions, and the whole variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apart(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit numbers where they fit, else Python's."""
        largest = self.n * (float(np.abs(rows).max(initial=0)) + 1)
        if largest < 2.0**62:
            return rows.astype(np.int64) * self.n - np.array(self.sums, np.int64)
        return rows.astype(np.int64).astype(object) * self.n - np.array(self.sums, object)

    def project(self, rows: np.ndarray) -> np.ndarray:
        return (self.apart(rows).astype(float) / self.n) @ self.vectors / np.sqrt(self.values)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)**2, exact; None where a long cannot hold one."""
        apart = self.apart(rows)
        if (apart.astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
            return (apart * apart).sum(axis=1).tolist()
        exact = (apart.astype(object) ** 2).sum(axis=1).tolist()
        return [x if x < 1 << 63 else None for x in exact]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """(id, vector) of the rows that take part, and their number of dimensions (0: no row)."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.where((F.size("vector") > 0) & F.forall("vector", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False))))
    lengths = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths["dims"] if lengths else 0
    return rows.where(F.size("vector") == dims), dims


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Learn the whitening of column ``vector``."""
    found = moments(vectors, dims)
    covariance = found.products / found.n
    values, directions = symmetric_eigen((covariance + covariance.T) / 2)
    kept = int((values[:components] > dims * np.finfo(float).eps * values[0]).sum())
    return Whitening(found.n, found.sums, values[:kept], directions[:, :kept], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, dims: int, learned: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    width = len(learned.values)
    found = moments(vectors, dims, learned.project, width)
    return float(np.abs(found.products / found.n - np.eye(width)).max())


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: the whitened value, beside n, deviation, explained and identity_error."""
    rows, dims = usable(vectors, id_column, vector_column)
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    learned = fit(rows, dims, components) if dims else None
    if learned is None or not len(learned.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, dims, learned)
    count = len(learned.values)
    names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(_matrix(batch.column(1), dims))
            size = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(size), count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * count, learned.n)), pa.array([d for d in learned.deviations(x) for _ in range(count)], pa.int64()),
                    pa.array(learned.project(x).ravel()), pa.array(np.tile(learned.values / learned.trace, size)), pa.array(np.full(size * count, error)),
                ],
                names=names,
            )

    return rows.select("id", "vector").mapInArrow(run, schema)
