"""Approximate nearest neighbours by cosine: a coarse quantiser, inverted lists that hold every vector, several lists probed a query.

The quantiser's centres are fitted on a bounded sample, which is as representative at any size; all vectors are put
into the list of their nearest centre. How many lists a query has to probe is measured on part of the sample, so that
a wanted recall is reached. Lists are cut into tiles of bounded size, and a query's copies go to all tiles of its
lists: a list with a third of all vectors is many tasks' work."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.scoring import rounded
from evalloom.operators.retrieval import DIGITS

#: Most vectors that the quantiser is fitted on, most lists, and sampled vectors that measure how many to probe.
SAMPLE, LISTS, TRIALS = 16_384, 4_096, 256
TILE, ROUNDS, SEED = 2_048, 8, 11


@dataclass
class Quantiser:
    centres: np.ndarray  # one a row, of length 1
    probes: int

    @property
    def share(self) -> float:
        return self.probes / len(self.centres)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fitted_centres(x: np.ndarray, lists: int) -> np.ndarray:
    """Centres of ``lists`` clusters of unit vectors, by rounds of assignment and means."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        empty = np.bincount(nearest, minlength=lists) == 0
        sums[empty] = x[rng.integers(0, len(x), empty.sum())]
        centres = unit(sums)
    return centres


def needed_probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float, trials: int) -> int:
    """The fewest lists to probe for this recall, as measured by sampled vectors as queries among the others."""
    rng = np.random.default_rng(SEED + 1)
    asked = rng.choice(len(x), min(trials, len(x)), replace=False)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(x) - 1)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    lists = (x @ centres.T).argmax(axis=1)
    # the place of each neighbour's list in the query's order of lists
    order = np.argsort(np.argsort(-(x[asked] @ centres.T), axis=1), axis=1)
    places = np.sort(np.take_along_axis(order, lists[best], axis=1).ravel())
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) + 1


def known(points: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Ids and vectors that are there, without null, infinite or missing entries."""
    v = F.col(vector).cast("array<double>")
    return points.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).alias("id"), v.alias("v")).where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def fit(points: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, recall: float = 0.97, sample: int = SAMPLE, lists: int | None = None) -> Quantiser:
    """A quantiser from at most ``sample`` vectors, those with the smallest hashes of their ids; lists are about the root of the number of vectors.

    Vectors have as many entries as most have; others aren't indexed."""
    rows = known(points, id_col, vector)
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    total = usual["rows"] if usual else 0
    rows = rows.where(F.size("v") == (usual["n"] if usual else 0))
    some = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], np.float64)
    if not total:
        return Quantiser(np.zeros((1, 0)), 1)
    some = unit(some)
    lists = min(lists or max(1, 2 * math.isqrt(total)), LISTS, max(1, len(some) // 4))
    centres = fitted_centres(some, lists)
    return Quantiser(centres, needed_probes(some, centres, k, recall, TRIALS) if len(some) > 1 else 1)


def index(points: DataFrame, quantiser: Quantiser, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, list): every vector, scaled to length 1, in the list of its nearest centre."""
    return _near(known(points, id_col, vector), quantiser, 1)


def _near(rows: DataFrame, quantiser: Quantiser, n: int) -> DataFrame:
    """(id, v, list) with the ``n`` nearest lists of each vector."""
    by = rows.sparkSession.sparkContext.broadcast(quantiser.centres)
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])
    dims = quantiser.centres.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = by.value
        for batch in batches:
            length = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.flatnonzero(length == dims)))
            if not batch.num_rows:
                continue
            x = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            score = x @ centres.T
            near = np.argsort(-score, axis=1, kind="stable")[:, :n] if n > 1 else score.argmax(axis=1)[:, None]
            at = np.repeat(np.arange(len(x)), near.shape[1])
            ends = pa.array(np.arange(len(at) + 1) * dims, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(x[at].ravel())), pa.array(near.ravel().astype(np.int32))], names=schema.names)

    return rows.mapInArrow(assign, schema)


def search(lists: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int = 10, probes: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): the best of the probed lists for each query, itself left out; scores and ties as in ``retrieval.top_k``.

    ``lists`` is what ``index`` gives, written as a table if more than one search reads it."""
    from pyspark.sql import Window

    dims, kind = quantiser.centres.shape[1], lists.schema["id"].dataType
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = lists.join(F.broadcast(sizes), "list").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    asked = _near(known(queries, id_col, vector), quantiser, probes or quantiser.probes).join(F.broadcast(sizes), "list").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = dealt.select("list", "tile", F.lit(0).alias("asks"), "id", "v").unionByName(asked.select("list", "tile", F.lit(1).alias("asks"), "id", "v"))
    rows = rows.repartition("list", "tile").sortWithinPartitions("list", "tile", "asks", "id")
    schema = T.StructType([T.StructField("qid", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])

    def met(points: list, asks: list) -> Iterator[pa.RecordBatch]:
        if not points or not asks:
            return
        p, q = (pa.Table.from_batches(x).combine_chunks().to_batches()[0] for x in (points, asks))
        x, y = (b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for b in (p, q))
        for a in range(0, len(y), TILE):
            score = np.round(y[a : a + TILE] @ x.T, DIGITS)
            own = pa.compute.index_in(q.column(3).slice(a, TILE), p.column(3)).to_numpy(zero_copy_only=False).astype(np.float64)
            itself = np.flatnonzero(~np.isnan(own))
            score[itself, own[itself].astype(np.int64)] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            at, n = best.ravel(), np.repeat(np.arange(len(score)), best.shape[1])
            kept = score[n, at] > -np.inf
            yield pa.RecordBatch.from_arrays([q.column(3).slice(a, TILE).take(pa.array(n[kept])), p.column(3).take(pa.array(at[kept])), pa.array(score[n[kept], at[kept]])], names=schema.names)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, points, asks = None, [], []
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            kinds = batch.column(2).to_numpy()
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(key)], strict=True):
                if b == a:
                    continue
                if key[a] != now:
                    yield from met(points, asks)
                    now, points, asks = key[a], [], []
                (asks if kinds[a] else points).append(batch.slice(a, b - a))
                # many queries of one tile are met in parts
                if kinds[a] and sum(x.num_rows for x in asks) >= TILE:
                    yield from met(points, asks)
                    asks = []
        yield from met(points, asks)

    found = rows.mapInArrow(scored, schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact neighbours (qid, id) were found."""
    both = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", rounded(F.coalesce(F.try_divide("found", "wanted"), F.lit(1.0)), 4))
