"""Whitening of embeddings: principal components of the distinct vectors, scaled to unit variance.

Entries are quantised to whole numbers, x = floor(64 * c) + 1,000,000, so that equal vectors are equal and sums are
exact. The fit list holds each distinct vector once. It is written once and read three times: for the number of vectors
and the sums per dimension (exact), for the covariance (every entry minus its mean first, then the products), and for
the covariance of the whitened vectors, which shows how far they are from the identity. Each task adds up its own rows
and passes on one matrix, a row per dimension; the rows of all tasks are added by dimension in tasks again. Only the
finished matrix, dimensions squared, reaches the driver.

The driver decomposes it: Householder reflections make it tridiagonal, bisection on Sturm counts narrows each of the
leading eigenvalues down to neighbouring doubles, inverse iteration finds their vectors, orthogonalised within clusters
of close eigenvalues, and the reflections are undone. The components, dimensions times `COMPONENTS` numbers, go to all
tasks, where each row is projected. Rows are never shuffled for that.

Defined cases: rows whose vector is null, empty, or holds null, non-finite or huge entries (beyond `LARGEST`) take no
part, nor do vectors of another length than the most frequent one (of equally frequent ones, the greatest). Components
whose variance is below `RANK` of the largest are rounding and are not returned, so equal rows, or a single one, give an
empty result. Repeated rows are returned as often as they occur; null ids are allowed; extra columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DecimalType, DoubleType, IntegerType, LongType, StructField, StructType,
)

from seatmeter.llm.common import settled

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LARGEST = 2.0 ** 32          # of an entry; its x stays below 2^39
RANK = 1e-11
CLUSTER = 1e-3               # eigenvalues closer than this share of the norm are orthogonalised together

_ROW = "place int, sums array<double>"


def quantised(vector: Column) -> Column:
    """The vector as whole numbers, null if it takes no part."""
    entry = vector.cast("array<double>")
    valid = (F.size(vector) > 0) & F.forall(entry, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))
    return F.when(valid, F.transform(entry, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


# ---- sums over the fit list -------------------------------------------------------------------------------------


def _exact_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, dtype=object)
        for batch in batches:
            x = _matrix(batch, size)
            n += len(x)
            for rows in np.array_split(x, len(x) // 4096 + 1):      # 2^12 entries below 2^39 fit in a long
                sums = sums + rows.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, size), pa.int32()), pa.array([Decimal(int(v)) for v in (n, *sums)], pa.decimal128(38))],
            ["place", "total"])

    rows = fit.mapInArrow(run, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    found = {r.place: int(r.total) for r in rows.collect()}
    return found.get(-1, 0), [found.get(k, 0) for k in range(size)]


def _added(parts: DataFrame) -> DataFrame:
    """Rows (place, sums) added by place. A task holds one row per place, however many it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, sums in zip(batch.column("place").to_pylist(), batch.column("sums")):
                sums = sums.values.to_numpy(zero_copy_only=False)
                held[place] = held[place] + sums if place in held else sums
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))],
            ["place", "sums"])

    return parts.repartition("place").mapInArrow(run, _ROW)


@dataclass
class Centre:
    """The mean as a whole number and a rest, so that x minus the mean keeps all its digits."""
    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - sum)^2, exactly."""
        far = int(np.abs(x - self.whole).max(initial=0)) + 1
        if len(self.sums) * (self.n * far) ** 2 < 2 ** 63:
            rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
            return (((x - self.whole) * self.n - rest) ** 2).sum(axis=1).tolist()
        return ((x.astype(object) * self.n - np.array(self.sums, dtype=object)) ** 2).sum(axis=1).tolist()


def _products(fit: DataFrame, size: int, made: int, values) -> tuple[np.ndarray, np.ndarray]:
    """The sums of `values(x)`, `made` numbers a row, and of their products, over the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((made + 1, made))
        for batch in batches:
            y = values(_matrix(batch, size))
            held[:made] += y.T @ y
            held[made] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(made + 1), pa.int32()), pa.array(list(held), pa.list_(pa.float64()))], ["place", "sums"])

    out = np.zeros((made + 1, made))
    for row in _added(fit.mapInArrow(run, _ROW)).collect():
        out[row.place] = row.sums
    return out[made], out[:made]


# ---- decomposition on the driver --------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix."""
    a, n, reflections = np.array(matrix, dtype=np.float64), len(matrix), []
    for k in range(n - 2):
        column = a[k + 1:, k].copy()
        if not column[1:].any():
            reflections.append(None)
            continue
        alpha = -np.copysign(np.linalg.norm(column), column[0])
        column[0] -= alpha
        v = column / np.linalg.norm(column)
        rest = a[k + 1:, k + 1:]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = alpha
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def smaller(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number of `at`, how many eigenvalues of the tridiagonal matrix are below it (Sturm count)."""
    tiny = np.finfo(float).tiny * max(1.0, float((off ** 2).max(initial=0)))
    count, q = np.zeros(len(at), dtype=np.int64), np.ones(len(at))
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (off[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The greatest eigenvalues, falling, each narrowed until no double lies between its bounds."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low = np.full(min(wanted, n), (diagonal - reach).min())
    high = np.full(len(low), np.nextafter((diagonal + reach).max(), np.inf))
    rank = n - 1 - np.arange(len(low))                 # eigenvalues below the wanted one
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return low
        above = smaller(diagonal, off, middle) > rank
        high, low = np.where(above, middle, high), np.where(above, low, middle)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x of (T - shift) x = right, by elimination with row exchanges."""
    n = len(diagonal)
    main, upper, second, y = diagonal - shift, np.append(off, 0.0), np.zeros(n), right.copy()
    for k in range(n - 1):
        below, next_main, next_upper = off[k], main[k + 1], upper[k + 1]
        if abs(below) > abs(main[k]):
            main[k], below = below, main[k]
            upper[k], next_main = next_main, upper[k]
            second[k], next_upper = next_upper, 0.0
            y[k], y[k + 1] = y[k + 1], y[k]
        elif main[k] == 0:
            main[k] = least
        factor = below / main[k]
        main[k + 1], upper[k + 1] = next_main - factor * upper[k], next_upper - factor * second[k]
        y[k + 1] -= factor * y[k]
    x = np.zeros(n + 2)
    for k in range(n - 1, -1, -1):
        pivot = main[k] if abs(main[k]) > least else least
        x[k] = (y[k] - upper[k] * x[k + 1] - second[k] * x[k + 2]) / pivot
    return x[:n]


def components(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a covariance, falling; those below `RANK` are left out."""
    size = float(np.abs(matrix).max(initial=0))
    if not size:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflections = tridiagonal(matrix / size)
    values = leading(diagonal, off, wanted)
    values = values[values > RANK * max(values[0], 0.0)]
    norm = float(max(np.abs(diagonal).max(), np.abs(off).max(initial=0)))
    least = np.finfo(float).eps * norm
    rng = np.random.default_rng(1)
    found: list[np.ndarray] = []
    for k, value in enumerate(values):
        cluster = [f for f, other in zip(found, values) if other - value <= CLUSTER * norm]
        x = rng.standard_normal(len(matrix))
        for _ in range(6):
            x = _solved(diagonal, off, value, x / np.abs(x).max(), least)
            x /= np.linalg.norm(x)
            for _ in range(2):
                for other in cluster:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
        found.append(x)
    vectors = np.array(found).T.reshape(len(matrix), len(found))
    for k in range(len(matrix) - 3, -1, -1):
        if (v := reflections[k]) is not None:
            vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    return values * size, vectors


# ---- the operator -----------------------------------------------------------------------------------------------


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error for each row that takes part."""
    schema = StructType([
        rows.schema[key], StructField("component", IntegerType()), StructField("n", LongType()),
        StructField("deviation", DecimalType(38, 0)), StructField("whitened", DoubleType()),
        StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    rows = rows.select(F.col(key).alias("key"), quantised(F.col(vector)).alias("x")).where("x IS NOT NULL")
    fit = settled(rows.select("x").distinct(), "whitening-fit")
    sizes = fit.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], schema)
    size = sizes["size"]
    rows, fit = rows.where(F.size("x") == size), fit.where(F.size("x") == size)

    centre = Centre(*_exact_sums(fit, size))
    left, products = _products(fit, size, size, centre.centred)
    covariance = products / centre.n
    values, vectors = components(covariance, wanted)
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    scaled = vectors / np.sqrt(values)
    off_centre = left / centre.n @ scaled              # the mean of the whitened rows: rounding
    _, identity = _products(fit, size, len(values), lambda x: centre.centred(x) @ scaled - off_centre)
    error = float(np.abs(identity / centre.n - np.eye(len(values))).max())
    explained = values / np.trace(covariance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part, size)
                each = np.repeat(np.arange(len(x)), k)
                deviation = pa.array([Decimal(v) for v in centre.deviation(x)], pa.decimal128(38))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(each), centre.n)), deviation.take(pa.array(each)),
                     pa.array((centre.centred(x) @ scaled).ravel()), pa.array(np.tile(explained, len(x))),
                     pa.array(np.full(len(each), error))], schema.names)

    return rows.mapInArrow(run, schema)
