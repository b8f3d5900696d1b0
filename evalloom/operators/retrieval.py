"""Retrieval evaluation: exact nearest neighbours, case metrics, run aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.scoring import rounded

#: Points, and queries, that one matrix product takes.
TILE, BLOCK = 1024, 512
#: Tiles' results of a block that are merged at once, and results that a task holds.
MERGE, HELD = 4, 1 << 22
#: Groups of points for each core.
GROUPS = 2
DIGITS = 9


def tiles(rows: DataFrame, rows_each: int) -> DataFrame:
    """(id, vector) as (ids, vectors): runs of rows of one task, their vectors scaled to length 1, as the bytes of a matrix."""
    kind = rows.schema.fields[0].dataType

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows_each):
                part = batch.slice(i, rows_each)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([unit.tobytes()], pa.binary())], names=["ids", "vectors"])

    return rows.mapInArrow(packed, T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("vectors", T.BinaryType())]))


def best(q: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's best ``k`` of (query, score), ties by ``order``, sorted by query."""
    at = np.lexsort((order, -score, q))
    return at[np.arange(len(q)) - np.searchsorted(q[at], q[at]) < k]


def point_groups(spark: SparkSession) -> int:
    """Groups of points, for each of which the queries are copied."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), GROUPS * spark.sparkContext.defaultParallelism)


def top_k(points: DataFrame, queries: DataFrame, dims: int, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): each query's nearest points by cosine on the first ``dims`` dimensions, itself left out.

    Ids and vectors that are null are left out, as are vectors with fewer than ``dims`` entries or with entries that are null or not finite;
    a vector of zeros has the score 0; ties go to the smaller id.
    """
    first = F.slice(F.col(vector), 1, dims).cast("array<double>")
    whole = F.forall(first, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    known = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) >= dims) & whole
    held, asked = (tiles(rows.where(known).select(id_col, first.alias("v")), n) for rows, n in ((points, TILE), (queries, BLOCK)))
    return nearest(held, asked, k, id_col)


def nearest(points: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", few: bool = False) -> DataFrame:
    """(qid, id, score, rank): the nearest points of queries, both as ``tiles``.

    A tile meets each block of queries once, in one matrix product. Blocks are copied to as many
    groups of tiles as keep the cluster's cores busy, which don't grow with the tables as shuffle partitions do: copies of the
    queries grow with the queries alone. Queries so ``few`` that every task can have them all go to the tiles where these are."""
    asked = queries.select(F.xxhash64("ids", "vectors").alias("block"), F.col("ids").alias("qids"), F.col("vectors").alias("asked"))
    if few:
        pairs = points.crossJoin(F.broadcast(asked))
    else:
        groups = point_groups(points.sparkSession)
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part")
        pairs = points.withColumn("part", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(groups))).join(asked.select("*", part), "part")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), id_col))
    return best_of_tasks(pairs.select("ids", "vectors", "block", "qids", "asked"), k, id_col).withColumn("rank", rank).where(F.col("rank") <= k)


def best_of_tasks(pairs: DataFrame, k: int, id_col: str) -> DataFrame:
    """(qid, id, score): the best ``k`` of each query over all tiles that a task sees.

    A query's k-th best score so far is its floor, below which nothing counts. Beyond ``HELD`` results are merged; only if half of them
    remain, from some 400,000 queries on for five each, are they let go."""
    kind = pairs.schema["ids"].dataType.elementType
    names = ["qid", id_col, "score"]

    def found(ids: pa.Array, data: pa.Scalar, qids: pa.Array, asked: pa.Scalar, floor: np.ndarray | None) -> tuple[pa.RecordBatch, np.ndarray]:
        order = pc.sort_indices(ids)
        ids, p = ids.take(order), np.frombuffer(data.as_buffer()).reshape(len(ids), -1)[order.to_numpy()]
        score = np.frombuffer(asked.as_buffer()).reshape(len(qids), -1) @ p.T
        np.round(score, DIGITS, out=score)
        own = pc.index_in(qids, ids).to_numpy(zero_copy_only=False)
        itself = np.flatnonzero(~np.isnan(own.astype(np.float64)))
        score[itself, own[itself].astype(np.int64)] = -np.inf
        if floor is None:
            floor = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(qids), -2.0)
        q, at = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        # of ties at the end those with the smallest ids
        kept = best(q, score[q, at], at, k)
        q, at = q[kept], at[kept]
        return pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids.take(pa.array(at)), pa.array(score[q, at])], names=names), floor

    def merged(parts: list[pa.RecordBatch], qids: pa.Array, floor: np.ndarray) -> pa.RecordBatch:
        """The best of ``parts``; raises the floors of the queries that have ``k`` there."""
        both = pa.Table.from_batches(parts).combine_chunks()
        q, ids, score = (both.column(i).combine_chunks() if both.num_rows else pa.array([], both.schema.types[i]) for i in range(3))
        order = pc.rank(q, tiebreaker="dense").to_numpy()
        kept = best(order, score.to_numpy(), pc.rank(ids, tiebreaker="dense").to_numpy(), k)
        q, ids, score, order = q.take(pa.array(kept)), ids.take(pa.array(kept)), score.take(pa.array(kept)), order[kept]
        kth = np.flatnonzero(np.arange(len(order)) - np.searchsorted(order, order) == k - 1)
        at = pc.index_in(q.take(pa.array(kth)), qids).to_numpy()
        floor[at] = np.maximum(floor[at], score.to_numpy()[kth])
        return pa.RecordBatch.from_arrays([q, ids, score], names=names)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by block
        held: dict[int, list[pa.RecordBatch]] = {}
        floors: dict[int, tuple[pa.Array, np.ndarray]] = {}
        rows = 0

        def merge(block: int) -> int:
            before = sum(x.num_rows for x in held[block])
            held[block] = [merged(held[block], *floors[block])]
            return held[block][0].num_rows - before

        for batch in batches:
            for i in range(batch.num_rows):
                ids, data, block, qids, asked = (c[i] for c in batch.columns)
                block = block.as_py()
                more, floor = found(ids.values, data, qids.values, asked, floors[block][1] if block in floors else None)
                if block not in floors:
                    # copies, which don't keep the batch that they come from
                    floors[block] = (qids.values.take(pa.array(np.arange(len(qids)))), np.array(floor))
                held.setdefault(block, []).append(more)
                rows += more.num_rows
                if len(held[block]) >= MERGE:
                    rows += merge(block)
                if rows > HELD:
                    rows += sum([merge(b) for b in held if len(held[b]) > 1])
                    if rows > HELD // 2:
                        for parts in held.values():
                            yield from parts
                        held.clear()
                        rows = 0
        for b in held:
            merge(b)
            yield from held[b]

    return pairs.mapInArrow(scored, T.StructType([T.StructField("qid", kind), T.StructField(id_col, kind), T.StructField("score", T.DoubleType())]))


def case_metrics(cases: DataFrame, retrieved: DataFrame, gold: DataFrame, k: int | str, id_col: str = "vec_id", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """A row for each case; the metrics are null where a case has no gold, and not rounded: means and differences are made of them.

    ``by`` are the columns that name a case (a run's number too, for several runs at once); ``k`` is a number or a column of
    ``cases`` and of ``retrieved``."""
    depth = F.col(k) if isinstance(k, str) else F.lit(k)
    keys, kept = list(by), [k] if isinstance(k, str) else []
    sizes = gold.groupBy(*keys).agg(F.count_distinct(id_col).alias("gold_count"))
    found = retrieved.where(F.col("rank") <= depth)
    hits = found.join(gold.select(*keys, id_col).distinct(), [*keys, id_col], "left_semi").groupBy(*keys).agg(F.count("*").alias("hits"), F.min("rank").cast("long").alias("first_hit_rank"))
    joined = cases.select(*keys, *kept).join(sizes, keys, "left").join(hits, keys, "left")
    has = F.col("gold_count").isNotNull()
    n = F.coalesce("hits", F.lit(0))
    return joined.select(
        *keys,
        *kept,
        F.coalesce("gold_count", F.lit(0)).alias("gold_count"),
        F.when(has, n).alias("hits"),
        F.when(has, n / F.col("gold_count")).alias("recall"),
        F.when(has, n / depth).alias("precision"),
        F.when(has, F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(has, (n > 0).cast("double")).alias("hit"),
        F.when(has, F.col("first_hit_rank")).alias("first_hit_rank"),
    )


def _aggregates() -> list[Column]:
    mean = lambda c: rounded(F.coalesce(F.avg(c), F.lit(0.0)))
    return [
        F.count("*").alias("cases_total"),
        F.count("recall").alias("cases_evaluated"),
        F.count_if(F.col("recall").isNull()).alias("cases_skipped_no_gold"),
        mean("recall").alias("recall_at_k"),
        mean("precision").alias("precision_at_k"),
        mean("reciprocal_rank").alias("mrr_at_k"),
        mean("hit").alias("hit_at_k"),
        rounded(F.avg(F.when(F.col("recall").isNotNull(), F.col("gold_count"))), 4).alias("avg_gold_chunks"),
        rounded(F.avg("hits"), 4).alias("avg_hits"),
    ]


def run_aggregate(metrics: DataFrame, k: int) -> DataFrame:
    """One row: means over cases with gold (0 without any), counts of the rest."""
    return metrics.agg(F.lit(k).cast("long").alias("k"), *_aggregates())


def run_aggregates(metrics: DataFrame) -> DataFrame:
    """The same for each ``k`` of the cases of several runs."""
    return metrics.groupBy(F.col("k").cast("long").alias("k")).agg(*_aggregates())
