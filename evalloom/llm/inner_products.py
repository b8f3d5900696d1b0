"""Exact top-k by inner product: the longest vectors first, with bounds by Cauchy and Schwarz.

Entries become whole numbers, floor(256 * entry). Points are dealt by ranges of falling length into groups of
bounded bytes, and a task goes through a group's tiles in that order. Vectors are rotated by the right singular
vectors of all points (the eigenvectors of their second moments, a dims x dims matrix), so that the first
coordinates have most of their length. For a block of queries and a tile a matrix product of the first coordinates
gives partial sums; a pair can score at most its partial sum and the product of what the two vectors have left, and
only pairs that may reach the query's k-th best so far go to the next coordinates. Those that stay get their exact
score from the whole numbers. A tile whose longest vector can't reach any query's k-th best ends the group.

Queries meet points in two waves: all of them meet the groups of the longest eighth of the points, and their k-th
best scores from there, a bound from below, go with them to the other groups. A query that can't do better in a
group isn't sent there, and what doesn't reach its bound isn't sent back.

Defined cases: vectors that are null or have entries that are null or not finite take no part, and so do those with
another number of entries than most vectors have, or with an entry of 2^61 or more after scaling; a query doesn't
meet its own row, but other rows with its id; equal scores go by the smaller id, null ids last; with fewer than k
points each query gets all; empty tables give empty results; other columns are not read. Scores beyond a long are
cut to the largest, or smallest, long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm.common import bounded_batches, discard, materialise
from evalloom.llm.vectors import scaled, tree_sum, usual_length

FACTOR = 256.0
MOST = 2.0**61
K = 5
#: Vectors of a tile, and of a block of queries.
TILE, BLOCK = 2048, 512
#: Bytes of a group's vectors, which one task holds, and least of them if there are enough groups for all tasks.
GROUP_BYTES, LEAST_GROUP = 32 << 20, 256 << 10
#: The part of all groups that queries meet first.
FIRST = 8
#: Parts of the coordinates after which bounds are tried.
STAGES = (0.25, 0.5)
#: Share of a block's pairs with a tile beyond which a whole matrix product costs less than the pairs one by one.
DENSE = 0.02
#: What rounding may take from a bound, as part of the two lengths' product.
SLACK = 1e-9
#: Sums of products of whole numbers below this are exact in doubles.
EXACT = 2.0**52
LONG = (1 << 63) - 1


def quantised(df: DataFrame, id_col: str, vector: str, asks: Column) -> tuple[DataFrame, int]:
    """(row_no, id, asks, length, x) of the vectors that take part, as a table, and their number of entries."""
    dims = usual_length(df, vector)
    rows = df.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector).alias("v"))
    schema = rows.select("row_no", "id", "asks", F.lit(0.0).alias("length"), F.array(F.lit(0).cast("long")).alias("x")).schema

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = scaled(batch.column(3), dims, FACTOR, MOST)
            if len(kept):
                ends = pa.array(np.arange(len(x) + 1) * dims, pa.int32())
                rest = [batch.column(i).take(pa.array(kept)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=schema.names)

    return materialise(rows.mapInArrow(whole, schema), "vectors"), dims


def rotation(points: DataFrame, dims: int) -> np.ndarray:
    """The right singular vectors of all points as columns, those of the largest singular values first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0), dims).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    found = tree_sum(points.select("x").mapInArrow(moments, "m binary"), lambda r: np.frombuffer(r["m"]).reshape(dims, dims).copy(), lambda a, b: a + b)
    return np.eye(dims) if found is None else np.linalg.eigh(found)[1][:, ::-1].copy()


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Points:
    """Vectors as whole numbers and rotated, with what length they have left after each stage."""

    def __init__(self, x: np.ndarray, axes: np.ndarray, cuts: list[int]) -> None:
        self.x = x.astype(np.float64)
        self.whole = x
        self.y = self.x @ axes
        self.length = np.sqrt((self.x**2).sum(axis=1))
        self.left = [np.sqrt((self.y[:, c:] ** 2).sum(axis=1)) for c in cuts]

    def some(self, i: int, j: int) -> Points:
        out = object.__new__(Points)
        out.x, out.whole, out.y, out.length, out.left = self.x[i:j], self.whole[i:j], self.y[i:j], self.length[i:j], [r[i:j] for r in self.left]
        return out


def exact(q: np.ndarray, p: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of ``q`` with rows of ``p``, one by one, as longs."""
    if most < EXACT:
        return np.einsum("ij,ij->i", q.astype(np.float64), p.astype(np.float64)).astype(np.int64)
    sums = (q.astype(object) * p.astype(object)).sum(axis=1)
    return np.array([max(-LONG - 1, min(LONG, s)) for s in sums], np.int64)


def reaching(q: Points, p: Points, least: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of the pairs that score ``least`` or more; ``least`` is a bound for each query."""
    slack = SLACK * q.length[:, None] * p.length
    most = float(q.length.max() * p.length.max())
    sums, begun, i, j = np.zeros((len(q.x), len(p.x))), 0, None, None
    for cut, lq, lp in zip(cuts, q.left, p.left, strict=True):
        if i is None:
            sums += q.y[:, begun:cut] @ p.y[:, begun:cut].T
            may = sums + lq[:, None] * lp + slack >= least[:, None]
            if (n := np.count_nonzero(may)) <= DENSE * may.size:
                i, j = np.nonzero(may)
                part = sums[i, j]
        else:
            part = part + np.einsum("ij,ij->i", q.y[i, begun:cut], p.y[j, begun:cut])
            may = part + lq[i] * lp[j] + slack[i, j] >= least[i]
            i, j, part = i[may], j[may], part[may]
        begun = cut
        if i is not None and not len(i):
            break
    if i is None and most < EXACT:
        score = q.x @ p.x.T
        i, j = np.nonzero(score >= least[:, None])
        return i, j, score[i, j].astype(np.int64)
    if i is None:
        i, j = np.nonzero(sums + slack > -np.inf)
    score = exact(q.whole[i], p.whole[j], most)
    kept = score >= least[i]
    return i[kept], j[kept], score[kept]


class Best:
    """The k best (score, id, row) of each query of a block so far; ids as places in the order of ids."""

    def __init__(self, n: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.q, self.score, self.place = (np.empty(0, np.int64) for _ in range(3))
        self.n = n

    def add(self, q: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        q, score, place = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.place, place])
        order = np.lexsort((place, ~score, q))
        q, score, place = q[order], score[order], place[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        kept = nth < self.k
        self.q, self.score, self.place = q[kept], score[kept], place[kept]
        last = nth == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last].astype(np.float64))


def searched(points: DataFrame, queries: DataFrame, dims: int, axes: np.ndarray, k: int, tasks: int) -> DataFrame:
    """(query_no, query_id, row_no, id, score) of each group's best for each query that came to it.

    ``points`` have a ``group``; ``queries`` one as well, copied to each group they meet, and ``least``, a score that counts."""
    both = ["group", "asked", "block", "row_no", "id", "x", "least"]
    rows = points.select("group", F.lit(0).alias("asked"), (-F.col("length")).alias("block"), "row_no", "id", "x", F.lit(None).cast("double").alias("least"))
    rows = rows.unionByName(queries.select("group", F.lit(1).alias("asked"), F.col("block").cast("double"), "row_no", "id", "x", "least").select(*both))
    rows = rows.repartition(tasks, "group").sortWithinPartitions("group", "asked", "block", F.col("id").asc_nulls_last(), "row_no")
    schema = points.select(F.col("row_no").alias("query_no"), F.col("id").alias("query_id"), "row_no", "id", F.lit(0).cast("long").alias("score")).schema
    cuts = [max(1, round(dims * s)) for s in STAGES]
    by = points.sparkSession.sparkContext.broadcast(axes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = by.value
        group, held, asked, kept = None, [], [], None

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal asked
            if asked and held or kept is not None and asked:
                block = pa.Table.from_batches(asked).combine_chunks().to_batches()[0]
                yield from met(block)
            asked = []

        def ready() -> None:
            """The group's points, once all are there: by falling length, with the order of their ids."""
            nonlocal kept, held
            if kept is None and held:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                order = pc.sort_indices(pa.table({"id": table.column("id"), "n": table.column("row_no")}), [("id", "ascending"), ("n", "ascending")], null_placement="at_end")
                place = np.empty(table.num_rows, np.int64)
                place[order.to_numpy()] = np.arange(table.num_rows)
                kept = (Points(matrix(table.column("x"), dims), axes, cuts), table.column("row_no"), table.column("id"), place, order)
                held = []

        def met(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ready()
            if kept is None:
                return
            p, numbers, ids, place, order = kept
            q = Points(matrix(block.column("x"), dims), axes, cuts)
            own = block.column("row_no").to_numpy()
            least = block.column("least").to_numpy(zero_copy_only=False)
            best = Best(len(own), k, least)
            row = numbers.to_numpy()
            for a in range(0, len(row), TILE):
                tile = p.some(a, a + TILE)
                if (q.length * tile.length[0] * (1 + SLACK) < best.least).all():
                    break
                i, j, score = reaching(q, tile, best.least, cuts)
                other = row[a + j] != own[i]
                if other.any():
                    best.add(i[other], score[other], place[a + j[other]])
            at = order.take(pa.array(best.place))
            yield pa.RecordBatch.from_arrays([block.column("row_no").take(pa.array(best.q)), block.column("id").take(pa.array(best.q)), numbers.take(at), ids.take(at), pa.array(best.score)], names=schema.names)

        for batch in batches:
            groups, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(groups)], strict=True):
                if groups[a] != group:
                    yield from blocks()
                    group, held, kept = groups[a], [], None
                if not kinds[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                for c in range(a, b, BLOCK):
                    asked.append(batch.slice(c, min(BLOCK, b - c)))
                    if sum(x.num_rows for x in asked) >= BLOCK:
                        yield from blocks()
        yield from blocks()

    return rows.mapInArrow(search, schema)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row_no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, asks: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_no, query_id, rank, row_no, id, score): for each row that ``asks`` the k others with the largest inner products."""
    spark = df.sparkSession
    bounded_batches(spark)
    points, dims = quantised(df, id_col, vector, asks)
    if not dims:
        return points.select(F.col("row_no").alias("query_no"), F.col("id").alias("query_id"), F.lit(1).alias("rank"), "row_no", "id", F.lit(0).cast("long").alias("score"))
    axes = rotation(points, dims)
    tasks, size = int(spark.conf.get("spark.sql.shuffle.partitions")), points.count() * (dims * 8 + 32)
    groups = max(1, -(-size // GROUP_BYTES), min(tasks, size // LEAST_GROUP))
    dealt = points.repartitionByRange(groups, F.desc("length"), F.col("id").asc_nulls_last(), "row_no")
    dealt = materialise(dealt.withColumn("group", F.spark_partition_id()), "vectors-by-length")
    discard(points)
    # ranges of falling length: the first groups have the longest vectors
    longest = materialise(dealt.groupBy("group").agg(F.max("length").alias("longest")), "groups")
    first = max(1, groups // FIRST)
    asked = dealt.where("asks").select("row_no", "id", "x", "length", F.floor(F.col("row_no") / BLOCK).alias("block"))
    copied = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)) if b > a else F.array().cast("array<int>")).alias("group")
    at_once = searched(dealt.where(F.col("group") < first), asked.select("*", F.lit(float("-inf")).alias("least"), copied(0, first)), dims, axes, k, tasks)
    before = materialise(best_of(at_once, k).drop("rank"), "best")
    bound = before.groupBy("query_no").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("bound"))
    again = asked.join(bound, F.col("row_no") == F.col("query_no"), "left").select(*asked.columns, F.coalesce("bound", F.lit(float("-inf"))).alias("least"))
    sent = again.select("*", copied(first, groups)).join(longest, "group").where(F.col("longest") * F.col("length") * (1 + SLACK) >= F.col("least"))
    after = searched(dealt.where(F.col("group") >= first), sent, dims, axes, k, tasks)
    return best_of(before.unionByName(after), k).select("query_no", "query_id", "rank", "row_no", "id", "score")


SQL = """with v as (select row_number() over () n, vec_id, list_transform(embedding, lambda c: floor(256 * c::double)) x from embeddings
 where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
 s as (select q.n, q.vec_id query_id, p.vec_id, list_inner_product(q.x, p.x)::bigint score from v q join v p on q.n <> p.n where q.vec_id % 50 = 0)
 select query_id, (row_number() over (partition by n order by score desc, vec_id))::int "rank", vec_id, score from s qualify "rank" <= 5"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
