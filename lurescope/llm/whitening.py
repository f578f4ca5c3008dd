"""Whitening of embeddings: leading principal components to double precision, and projection on them.

Two passes over the vectors fit the model. The first sums every dimension exactly, in integers. The second centres each
vector by those sums before multiplying, and adds up one ``d x d`` matrix per task; its rows are summed by
Spark, one group per dimension. Only ``d x d`` numbers reach the driver, whatever the number of vectors.

There the covariance is reduced to a tridiagonal matrix by Householder reflections. A Sturm count says how many
eigenvalues of a tridiagonal matrix lie below a number, and bisecting with it finds the leading ones. Inverse
iteration gives each its vector; vectors of a cluster of close eigenvalues are made orthogonal to each other in
every step. The reflections carry them back. Projecting on the broadcast components (``k x d`` numbers) is a map
over the rows.

Entries are taken as the integers ``floor(1024 * c) + 100000``, so the sums, and each row's deviation, are exact.

Defined cases: a row whose vector is null, empty, or holds null or non-finite entries (or numbers of 2**52 and more) is left out. So is
one whose length isn't the table's most frequent one (the longer of two equally frequent). Repeated rows and null or repeated ids
are rows of their own. Directions without variance (an eigenvalue of at most 1e-12 of the trace) are no
components, so a table of one vector, or of equal vectors, gives no row, like an empty one. Extra
columns are ignored. A lost executor repeats its own partitions; nothing is kept on a machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.session import stored

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
LARGEST = 2.0**52  # 1024 times it is still a 64-bit integer
NO_VARIANCE = 1e-12
CLUSTER = 1e-3


# --- eigenvectors of a symmetric matrix -------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix by Householder reflections.

    Reflection ``k`` is ``I - 2 v v'`` on the dimensions from ``k + 1`` on.
    """
    a = np.array(matrix, dtype=np.float64)
    n, reflections = len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if np.abs(v[1:]).max() == 0:
            reflections.append(np.zeros_like(v))
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = 2.0 * (block @ v)
        w = p - (v @ p) * v
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2.0 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def count_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: for each number how many eigenvalues are less than it (negative pivots of T - x)."""
    smallest = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    pivot = diagonal[0] - x
    pivot = np.where(np.abs(pivot) < smallest, -smallest, pivot)
    below = (pivot < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off * off, strict=True):
        pivot = d - x - e / pivot
        pivot = np.where(np.abs(pivot) < smallest, -smallest, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until neighbouring doubles are left."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.insert(off, 0, 0.0))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    margin = np.finfo(np.float64).eps * max(1.0, np.abs(low[0]), np.abs(high[0])) * n
    low, high = low - margin, high + margin
    wanted = n - 1 - np.arange(k)  # that many eigenvalues lie below the one sought
    while True:
        middle = low + (high - low) / 2
        done = (middle <= low) | (middle >= high)
        if done.all():
            return middle
        less = count_below(diagonal, off, middle) <= wanted
        low, high = np.where(~done & less, middle, low), np.where(~done & ~less, middle, high)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; pivots near zero are replaced by ``least``."""
    n = len(diagonal)
    d, u = diagonal - shift, np.append(off, 0.0)
    lower, second, x = off.copy(), np.zeros(n), right.copy()
    for i in range(n - 1):
        if abs(lower[i]) > abs(d[i]):
            d[i], lower[i] = lower[i], d[i]
            u[i], d[i + 1] = d[i + 1], u[i]
            second[i], u[i + 1] = u[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        pivot = d[i] if abs(d[i]) > least else np.copysign(least, d[i])
        d[i] = pivot
        factor = lower[i] / pivot
        d[i + 1] -= factor * u[i]
        u[i + 1] -= factor * second[i]
        x[i + 1] -= factor * x[i]
    if abs(d[-1]) <= least:
        d[-1] = np.copysign(least, d[-1])
    for i in range(n - 1, -1, -1):
        rest = u[i] * x[i + 1] if i + 1 < n else 0.0
        rest += second[i] * x[i + 2] if i + 2 < n else 0.0
        x[i] = (x[i] - rest) / d[i]
    return x


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One unit vector per eigenvalue (falling) by inverse iteration."""
    n = len(diagonal)
    size = max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0, np.finfo(np.float64).tiny)
    least = np.finfo(np.float64).eps * size
    start = np.random.default_rng(1)
    found: list[np.ndarray] = []
    first = 0  # of the current cluster
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * size:
            first = k
        shift = value - (k - first) * 2 * least  # equal eigenvalues get different systems
        x = start.standard_normal(n)
        for _ in range(6):
            x = _solved(diagonal, off, shift, x / np.linalg.norm(x), least)
            x /= np.linalg.norm(x)
            for _ in range(2):
                for y in found[first:k]:
                    x -= (x @ y) * y
            x /= np.linalg.norm(x)
        found.append(x)
    return np.array(found).reshape(len(values), n)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    n = len(matrix)
    k = min(k, n)
    size = np.abs(matrix).max()
    if size == 0:
        return np.zeros(k), np.eye(n)[:k]
    diagonal, off, reflections = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        vectors[:, i + 1 :] -= 2.0 * np.outer(vectors[:, i + 1 :] @ v, v)
    return values * size, vectors


# --- tables of vectors ------------------------------------------------------


@dataclass
class Whitening:
    """A fitted model: row count, exact sums, eigenvalues (falling), unit components as rows, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def usable_vectors(df: DataFrame, vector: str = "embedding", dimensions: int | None = None) -> DataFrame:
    """(vec_id, x array<bigint>): the rows that can be used, as integers.

    ``dimensions``: the length to keep; by default the most frequent one.
    """
    entries = F.col(vector).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    whole = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), entries.alias("v")).where(F.coalesce((F.size(entries) > 0) & fine, F.lit(False)))
    if dimensions is None:
        sizes = whole.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
        most = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).first()
        dimensions = most["d"] if most else 0
    return whole.where(F.size("v") == dimensions).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task, as high and low parts that stay exact: |x| <= 2**62, so 2**26 rows fit."""
    low = high = None
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        x = _matrix(batch.column("x"))
        n += len(x)
        a, b = (x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0)
        high, low = (a, b) if high is None else (high + a, low + b)
    if n:
        d = len(low)
        yield pa.record_batch([pa.array(np.arange(d), pa.int32()), pa.array(high), pa.array(low), pa.array(np.full(d, n))], ["i", "high", "low", "n"])


def column_sums(x: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension; one row per task and dimension is shuffled."""
    parts = x.select("x").mapInArrow(_task_sums, "i int, high bigint, low bigint, n bigint")
    total = parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")])
    rows = total.orderBy("i").collect()
    return (int(rows[0]["n"]) if rows else 0), [(int(r["high"]) << 26) + int(r["low"]) for r in rows]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off in integers, so no digits are lost."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def covariance(x: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor ``n`` of centred rows; ``d`` rows of ``d`` numbers per task are shuffled."""
    d = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                y = _centred(_matrix(batch.column("x")), n, sums)
                total += y.T @ y
        yield pa.record_batch([pa.array(np.arange(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = x.select("x").mapInArrow(products, "i int, row array<double>")
    total = parts.groupBy("i").agg(F.array(*[F.sum(F.get("row", F.lit(j))) for j in range(d)]).alias("row"))
    matrix = np.zeros((d, d))
    for r in total.collect():
        matrix[r["i"]] = r["row"]
    return (matrix + matrix.T) / (2 * n)


def fit_whitening(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit over all rows of ``x`` (:func:`usable_vectors`, stored); None without rows or variance."""
    n, sums = column_sums(x)
    if not n:
        return None
    matrix = covariance(x, n, sums)
    trace = float(np.trace(matrix))
    if trace <= 0:
        return None
    values, vectors = leading_components(matrix, components)
    real = values > NO_VARIANCE * trace
    return Whitening(n, sums, values[real], vectors[real], trace)


def whiten(x: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation decimal(38,0), whitened array<double>``: every row projected on the components.

    ``deviation`` is the sum over dimensions of (n * x - S)**2, exactly.
    """
    shared = x.sparkSession.sparkContext.broadcast((model.n, model.sums, model.components, np.sqrt(model.values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, components, roots = shared.value
        for batch in batches:
            if not len(batch):
                continue
            rows = _matrix(batch.column("x"))
            deviation = exact_deviation(rows, n, sums)
            projected = (_centred(rows, n, sums) @ components.T) / roots
            yield pa.record_batch(
                [batch.column("vec_id"), pa.array([str(v) for v in deviation]), pa.array(list(projected), pa.list_(pa.float64()))],
                ["vec_id", "deviation", "whitened"],
            )

    rows = x.mapInArrow(run, "vec_id bigint, deviation string, whitened array<double>")
    return rows.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")


def exact_deviation(rows: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)**2: in 64 bits where a bound shows that they suffice, else in Python's integers."""
    low, high = rows.min(axis=0).tolist(), rows.max(axis=0).tolist()
    largest = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums, strict=True))
    if largest**2 * len(sums) < 2**63 and n * max(map(abs, low + high)) < 2**63:
        y = rows * n - np.array(sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in rows.tolist()]


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest entry of the covariance of ``whitened`` (divisor: rows; centred first) minus the identity."""
    value = [F.get("whitened", F.lit(i)) for i in range(k)]
    means = whitened.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(value)]).first()
    centred = [v - F.lit(means[i]) for i, v in enumerate(value)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = whitened.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(row, cells, strict=True))


RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened_rows(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    A deviation beyond 64 bits ends the query with an error; :func:`whiten` has it as a decimal.
    """
    x = stored(usable_vectors(df))
    model = fit_whitening(x, components)
    if model is None:
        return df.sparkSession.createDataFrame([], RESULT)
    k = len(model.values)
    rows = stored(whiten(x, model))
    error = identity_error(rows, k)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), F.col("deviation").cast("bigint").alias("deviation"),
        "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
