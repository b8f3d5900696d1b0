"""Embeddings whitened by the eigenvectors of their covariance.

Entries become whole numbers, floor(64 * entry) + 1,000,000. A first pass adds them up, exactly, so that the mean is
a fraction of whole numbers. A second one takes the mean off each vector before it multiplies: tasks sum outer
products by matrix products, and ``treeAggregate`` merges a matrix a task. LAPACK's symmetric solver on the driver
gives the eigenvectors (its input is dims x dims, whatever the number of rows), which are broadcast: vectors times
eigenvectors over the roots of their eigenvalues have the unit matrix as covariance. A third pass measures how far
from it they are.

Defined cases: vectors that are null or have entries that are null or not finite are left out, and so are those with
another number of entries than most vectors have, or with an entry of 2^61 or more after scaling, which no long
holds; empty tables, and those without such vectors, give empty results; repeated rows count each, null ids are ids
like others. Directions without variance (an eigenvalue of at most 10^-10 of the largest) can't be whitened and have
no component, so that equal vectors have none at all. A deviation beyond a long is null. Other columns are kept;
those named ``deviation`` and as ``into`` says are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.common import bounded_batches
from evalloom.llm.vectors import scaled, tree_sum, usual_length

FACTOR, OFFSET, COMPONENTS = 64.0, 1_000_000, 32
#: Scaled entries are less than this.
MOST = 2.0**61
#: Part of the largest eigenvalue from which a smaller one counts.
LEAST_VARIANCE = 1e-10
LONG = 1 << 63


@dataclass
class Whitening:
    """n vectors' sums of whole numbers, and what takes centred ones to whitened ones."""

    dims: int
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    trace: float
    projection: np.ndarray
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def whole(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    rows, x = scaled(column, dims, FACTOR, MOST)
    return rows, x + OFFSET


def mean_parts(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The whole part of each mean and what is left of the sum, so that mean = whole + left / n."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def _sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many vectors there are and the exact sum of each entry, by halves of 32 bits within a task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            _, x = whole(batch.column(0), dims)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": [n], "high": [high.tolist()], "low": [low.tolist()]})

    found = tree_sum(
        vectors.mapInArrow(partial, "n long, high array<long>, low array<long>"),
        lambda r: (r["n"], [(h << 32) + l for h, l in zip(r["high"], r["low"], strict=True)]),
        lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]),
    )
    return found or (0, [0] * dims)


def _products(vectors: DataFrame, dims: int, n: int, sums: list[int], projection: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums, over all vectors, of the centred vectors and of their outer products; of projected ones, if so asked."""
    mean, left = mean_parts(n, sums)
    size = dims if projection is None else projection.shape[1]
    by = vectors.sparkSession.sparkContext.broadcast((mean, left / n, projection))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, rest, projection = by.value
        total, outer = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            d = (whole(batch.column(0), dims)[1] - mean) - rest
            d = d if projection is None else d @ projection
            total += d.sum(axis=0)
            outer += d.T @ d
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()], "outer": [outer.tobytes()]})

    return tree_sum(
        vectors.mapInArrow(partial, "total binary, outer binary"),
        lambda r: (np.frombuffer(r["total"]).copy(), np.frombuffer(r["outer"]).reshape(size, size).copy()),
        lambda a, b: (a[0] + b[0], a[1] + b[1]),
    )


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all vectors of ``df``: a model of dims x dims numbers."""
    bounded_batches(df.sparkSession)
    vectors = df.select(vector)
    dims = usual_length(vectors, vector)
    n, sums = _sums(vectors, dims) if dims else (0, [])
    if not n:
        return Whitening(dims, 0, sums, np.empty(0), 0.0, np.empty((dims, 0)))
    _, outer = _products(vectors, dims, n, sums)
    covariance = outer / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, axes = values[order], axes[:, order]
    kept = values > max(0.0, values[0]) * LEAST_VARIANCE
    kept[components:] = False
    values, axes = values[kept], axes[:, kept]
    if len(values):  # of the two signs the one that makes an axis' largest entry positive
        largest = np.abs(axes).argmax(axis=0)
        axes = axes * np.where(axes[largest, np.arange(len(values))] < 0, -1.0, 1.0)
    model = Whitening(dims, n, sums, values, float(np.trace(covariance)), axes / np.sqrt(values))
    if len(values):
        total, outer = _products(vectors, dims, n, sums, model.projection)
        mean = total / n
        model.identity_error = float(np.abs(outer / n - np.outer(mean, mean) - np.eye(len(values))).max())
    return model


def deviations(t: np.ndarray, left: np.ndarray, n: int) -> list[int | None]:
    """Sums of (n * t - left)^2, exactly; t are whole numbers less the whole part of the mean."""
    most = float(np.abs(t).max(initial=0)) * n + n
    if most * most * t.shape[1] < LONG / 2:
        d = t * n - left
        return (d * d).sum(axis=1).tolist()
    d = t.astype(object) * n - left.astype(object)
    return [int(s) if s < LONG else None for s in (d * d).sum(axis=1)]


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", into: str = "whitened") -> DataFrame:
    """``df`` with an array of the whitened entries of each vector, and ``deviation``; rows without a vector that counts are left out."""
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in (into.lower(), "deviation") or c == vector])
    schema = T.StructType([*kept.schema.fields, T.StructField("deviation", T.LongType()), T.StructField(into, T.ArrayType(T.DoubleType()))])
    at, dims, n = kept.columns.index(vector), model.dims, model.n
    mean, left = mean_parts(n, model.sums) if n else (np.empty(0), np.empty(0))
    by = df.sparkSession.sparkContext.broadcast((mean, left, model.projection))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, left, projection = by.value
        for batch in batches:
            rows, x = whole(batch.column(at), dims)
            if not n or not len(rows):
                continue
            t = x - mean
            w = (t - left / n) @ projection
            ends = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            arrays = [*batch.take(pa.array(rows)).columns, pa.array(deviations(t, left, n), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return kept.mapInArrow(project, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors)
    shares = F.array(*map(F.lit, model.explained)).cast("array<double>")
    out = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
