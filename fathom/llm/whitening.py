"""Whitened embeddings from a compensated covariance.

Each task adds the outer products of its centred vectors in double-double: a
product and its rounding error by an error-free transformation, sums by another.
High and low parts are merged over tasks in two steps of Spark, and a matrix of
one row and column a dimension meets the eigen-solver: Householder reflections to
a tridiagonal matrix, then divide and conquer (LAPACK's dsyevd, by numpy).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.base import bounded_batches, written

#: Steps in a unit, and what is added: entries become positive whole numbers.
STEPS, SHIFT = 64, 1_000_000
#: Scaled entries beyond this count as not finite: their sums have to stay exact.
LARGEST = float(1 << 31)
#: Products of a block of rows that are added pairwise; they should fit a core's cache.
BLOCK = 1 << 17
#: Groups into which the partial sums of tasks are merged before they meet.
GROUPS = 64
_SPLIT = float((1 << 27) + 1)
Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and its exact error."""
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def halves(a: np.ndarray) -> Pair:
    """Two numbers of 26 bits at most that add up to a."""
    c = _SPLIT * a
    high = c - (c - a)
    return high, a - high


def add(x: Pair, y: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    e = e + t
    s, e = s + e, e - ((s + e) - s)
    e = e + f
    high = s + e
    return high, e - (high - s)


def products(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> Pair:
    """rows[:, i] * rows[:, j] with the exact error of each product."""
    high, low = halves(rows)
    p = rows[:, i] * rows[:, j]
    error = ((high[:, i] * high[:, j] - p) + high[:, i] * low[:, j] + low[:, i] * high[:, j]) + low[:, i] * low[:, j]
    return p, error


def outer_sum(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> Pair:
    """The sum over rows of the products of columns i and j, in double-double."""
    total = np.zeros(len(i)), np.zeros(len(i))
    step = max(1, BLOCK // max(1, len(i)))
    for at in range(0, len(rows), step):
        x = products(rows[at : at + step], i, j)
        while len(x[0]) > 1:
            half = len(x[0]) // 2
            y = add((x[0][:half], x[1][:half]), (x[0][half : 2 * half], x[1][half : 2 * half]))
            x = tuple(np.concatenate([a, b[2 * half :]]) for a, b in zip(y, x, strict=True))
        total = add(total, (x[0][0], x[1][0]))
    return total


def integers(embedding: str) -> Column:
    """The entries as whole numbers; null where the vector or an entry is null, where an
    entry isn't finite or is so large that sums would not be exact, or there is no entry."""
    c = F.col(embedding)
    whole = lambda v: F.floor(v.cast("double") * STEPS).cast("long") + SHIFT
    good = F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double") * STEPS) < LARGEST, F.lit(False)) & ~F.isnan(v))
    return F.when((F.size(c) > 0) & good, F.transform(c, whole))


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * x - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n) @ (self.vectors / np.sqrt(self.values))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of rows and the sum of each dimension, exact in 64 bits."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)
        for batch in batches:
            n, total = n + len(batch), total + _matrix(batch.column("x"), d).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(total)], ["i", "n", "s"])

    found = fit.select("x").mapInArrow(some, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (found[0]["n"], np.array([r["s"] for r in found], np.int64)) if found else (0, np.zeros(d, np.int64))


def compensated(fit: DataFrame, columns: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> Pair:
    """The sum over fit of the outer products of columns(x), k by k, in double-double."""
    i, j = np.triu_indices(k)
    names = ["part", "high", "low"]

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(len(i)), np.zeros(len(i))
        for batch in batches:
            total = add(total, outer_sum(columns(_matrix(batch.column("x"), d)), i, j))
        part = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([t.tolist()], pa.list_(pa.float64())) for t in total)], names)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(i)), np.zeros(len(i))
        for high, low in zip(rows["high"], rows["low"], strict=True):
            total = add(total, (np.asarray(high), np.asarray(low)))
        return pd.DataFrame({"part": [0], "high": [total[0].tolist()], "low": [total[1].tolist()]})

    schema = "part int, high array<double>, low array<double>"
    parts = fit.select("x").mapInArrow(some, schema).groupBy("part").applyInPandas(merge, schema)
    found = parts.groupBy("part").applyInPandas(merge, schema).first()
    out = np.zeros((k, k)), np.zeros((k, k))
    if found:
        for m, v in zip(out, (found["high"], found["low"]), strict=True):
            m[i, j] = m[j, i] = v
    return out


def fit_whitening(fit: DataFrame, d: int, components: int) -> Whitening:
    """The model of the rows of fit, a column x of d whole numbers. Components whose
    variance is nothing beside rounding errors are left out."""
    n, s = sums(fit, d)
    none = Whitening(n, s, np.zeros(0), np.zeros((d, 0)), np.zeros(0))
    if not n:
        return none
    high, low = compensated(fit, lambda x: (n * x - s).astype(float), d, d)
    cube = float(n) * n * n
    covariance = high / cube + low / cube
    trace = float(np.trace(covariance))
    if not trace > 0:
        return none
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    order = order[values[order] > d * np.finfo(float).eps * trace]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, s, values[order], vectors, values[order] / trace)


def identity_error(fit: DataFrame, model: Whitening, d: int) -> float:
    """The largest entry of the covariance of the whitened rows of fit minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    high, low = compensated(fit, lambda x: np.column_stack([model.whitened(x), np.ones(len(x))]), d, k + 1)
    sums_of = (high + low) / model.n
    mean = sums_of[-1, :-1]
    return float(np.abs(sums_of[:-1, :-1] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 16) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of each row of rows
    whose vector has finite entries only; other columns are left out whatever their names.
    deviation is exact, a decimal; whitened and explained have an entry a component.

    The model is fitted on each distinct vector of whole numbers once, however many rows
    hold it. Rows with no vector, a null, a value that isn't finite or 2^31 or more once
    scaled are left out, and so are those whose length isn't the commonest (of equally
    common lengths the longest). Equal vectors have equal results; rows that share an id
    all stay. Where all vectors are one, and in an empty table, no component has any
    variance: the arrays are empty. The distinct vectors are written to the shared folder
    and read three times; only sums of a value or a square matrix of a dimension move on."""
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = rows.select(F.col(vec_id).alias("vec_id"), integers(embedding).alias("x")).where("x is not null")
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = size["d"] if size else 1
    rows = rows.where(F.size("x") == d)
    fit = written(rows.select("x").distinct(), "vectors")
    model = fit_whitening(fit, d, components)
    error = identity_error(fit, model, d)
    schema = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            apart = model.deviations(x)
            small = len(x) == 0 or d * float(np.abs(apart).max()) ** 2 < 2.0**62
            squares = (apart**2).sum(1) if small else [sum(v * v for v in row) for row in apart.tolist()]
            deviation = pa.array(squares).cast(pa.decimal128(19, 0)).cast(pa.decimal128(38, 0)) if small else pa.array(squares, pa.decimal128(38, 0))
            lists = [pa.array(v.tolist(), pa.list_(pa.float64())) for v in (model.whitened(x), np.tile(model.explained, (len(x), 1)))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array([model.n] * len(x), pa.int64()), deviation, *lists, pa.array([error] * len(x))], ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(whitened, schema)


def by_component(found: DataFrame) -> DataFrame:
    """A row for each component of each row of whiten(), numbered from 1."""
    each = found.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "one"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("one.whitened").alias("whitened"), F.col("one.explained").alias("explained"), "identity_error")
