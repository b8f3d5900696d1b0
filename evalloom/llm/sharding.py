"""Sharding by a K-d tree of weighted medians.

The items are groups of equal texts, so that copies share a shard; a group of more than a 16th of a shard's
bytes is dealt into parts first. A node of the tree that stands for k shards is split along the dimension in
which its items spread widest, at the item order's weighted median for floor(k / 2) of k shares, until a node
stands for one shard. A dimension's order is its value, on 2^31 steps between the corpus's least and largest,
then a hash: ties, as of a hot source, are cut like anything else.

Medians are found without moving items: sums of weights over ``BINS`` bins between two keys come to the
driver for all nodes of a level at once, the bracket shrinks to the bin that holds the median, and when it
has at most ``FEW`` items these are compared one by one. What comes to the driver depends on the number of
shards alone.

Defined cases: a null text has no bytes of its own (a row counts ``ROW_BYTES`` besides) and a checksum of 0;
null dimensions stand before all values; repeated rows are one group but have their own slots, and are dealt one
by one if their group is large; texts of any length count whole; text dimensions are ordered by their whole values'
ranks; an empty table gives an empty result; missing dimensions are left out; other columns, whatever their names,
play no part.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.common import discard, fresh, looked_up, materialise, text_frame

SHARDS = 40
ROW_BYTES = 16
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")
STEPS = 31
BINS = 1024
FEW = 2000
#: Rows that one task numbers.
SLOT_ROWS = 50_000


@dataclass
class Node:
    """A node of the tree: the first of the shards it stands for, and how many they are."""

    first: int
    shards: int

    def halves(self) -> list[Node]:
        half = self.shards // 2
        return [Node(self.first, half), Node(self.first + half, self.shards - half)]


def number(column: Column, kind: T.DataType) -> Column:
    """A dimension that isn't text as a number that keeps its order."""
    if isinstance(kind, (T.DateType, T.TimestampType)):
        column = column.cast("timestamp")
    return column.cast("double")


def ranks(rows: DataFrame, key: str) -> DataFrame:
    """(key, rank, rows) of the different values of a column: its place in their order, and how many rows have it."""
    values = rows.groupBy(key).agg(F.count("*").alias("rows")).repartitionByRange(key).withColumn("part", F.spark_partition_id())
    values = materialise(values, "shard-values")
    parts = values.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy().orderBy("part")) - F.col("n")).drop("n")
    ranked = values.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(key))).join(F.broadcast(before), "part")
    out = materialise(ranked.select(key, (F.col("own") + F.col("before")).cast("double").alias(f"rank_{key}"), "rows"), "shard-ranks")
    discard(values)
    return out


def split_level(items: DataFrame, dims: int, level: list[Node]) -> DataFrame:
    """Moves the items of each node of a level to its halves; items have ``node``, a weight ``w`` and keys ``k0``, ``k1``, ...

    The tables that are broadcast have a row for each node.
    """
    spark = items.sparkSession
    shards = {n.first: n.shards for n in level}
    keys = [f"k{d}" for d in range(dims)]
    spread = items.groupBy("node").agg(F.sum("w").alias("w"), F.count("*").alias("n"), *[F.struct(F.min(k).alias("lo"), F.max(k).alias("hi")).alias(k) for k in keys]).where("node is not null").collect()
    dim, brackets = {}, {}
    for r in spread:
        if (f := r["node"]) in shards:
            dim[f] = max(range(dims), key=lambda d: ((r[keys[d]]["hi"] >> STEPS) - (r[keys[d]]["lo"] >> STEPS), -d))
            brackets[f] = [*r[keys[dim[f]]], r["n"], 0, r["w"] * (shards[f] // 2) / shards[f]]
    chosen = F.broadcast(spark.createDataFrame(list(dim.items()), "node int, dim int"))
    at = items.join(chosen, "node").select("node", F.element_at(F.array(*keys), F.col("dim") + 1).alias("key"), "w")
    while wide := [(f, b[0], b[1], (b[1] - b[0]) // BINS + 1) for f, b in brackets.items() if b[2] > FEW and b[0] < b[1]]:
        bounds = F.broadcast(spark.createDataFrame(wide, "node int, lo long, hi long, step long"))
        binned = at.join(bounds, "node").where("key between lo and hi").select("node", F.expr("(key - lo) div step").alias("bin"), "key", "w")
        sums = defaultdict(list)
        for r in binned.groupBy("node", "bin").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect():
            sums[r["node"]].append(r)
        for f, *_ in wide:
            b = brackets[f]
            for r in sorted(sums[f], key=lambda r: r["bin"]):
                if b[3] + r["w"] >= b[4]:
                    b[0], b[1], b[2] = r["lo"], r["hi"], r["n"]
                    break
                b[3] += r["w"]
    bounds = F.broadcast(spark.createDataFrame([(f, b[0], b[1]) for f, b in brackets.items()], "node int, lo long, hi long"))
    few = defaultdict(list)
    for r in at.join(bounds, "node").where("key between lo and hi").groupBy("node", "key").agg(F.sum("w").alias("w")).collect():
        few[r["node"]].append((r["key"], r["w"]))
    cuts = []
    for f, b in brackets.items():
        below = b[3]
        best = (abs(b[4] - below), b[0] - 1)
        for key, w in sorted(few[f]):
            below += w
            best = min(best, (abs(b[4] - below), key))
        cuts.append((f, dim[f], best[1], f + shards[f] // 2))
    cut = F.broadcast(spark.createDataFrame(cuts, "node int, dim int, cut long, right int"))
    moved = items.join(cut, "node", "left").withColumn("node", F.when(F.element_at(F.array(*keys), F.col("dim") + 1) > F.col("cut"), F.col("right")).otherwise(F.col("node")))
    return materialise(moved.drop("dim", "cut", "right"), "shard-level")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row: shards of nearly equal bytes, slots gapless from 0 in each."""
    dims = [d for d in dimensions if d in docs.columns and isinstance(docs.schema[d].dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.BooleanType))]
    text = F.col(text_col)
    words = [i for i, d in enumerate(dims) if isinstance(docs.schema[d].dataType, T.StringType)]
    meta = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0)).cast("long").alias("crc"),
        F.xxhash64(text, F.octet_length(text)).alias("h"),
        # a null text dimension stands before all others
        *[F.when(F.col(d).isNull(), "0").otherwise(F.concat(F.lit("1"), d)).alias(f"d{i}") if i in words else number(F.col(d), docs.schema[d].dataType).alias(f"d{i}") for i, d in enumerate(dims)],
    )
    meta = materialise(meta, "shard-rows")
    if words:
        n_rows, read, ranked = meta.count(), meta, [ranks(meta, f"d{i}") for i in words]
        for i, values in zip(words, ranked, strict=True):
            read = looked_up(read, f"d{i}", values, "rows", n_rows).drop(f"d{i}").withColumnRenamed(f"rank_d{i}", f"d{i}")
        plain, meta = meta, materialise(read, "shard-rows")
        discard(plain, *ranked)
    n, total, *ends = meta.agg(F.count("*"), F.sum("size"), *[f(f"d{i}") for i in range(len(dims)) for f in (F.min, F.max)]).first()
    part_bytes = max(1, (total or 0) // (shards * 16))
    groups = meta.groupBy("h").agg(F.sum("size").alias("bytes"))
    # at most 16 for each shard, since each holds more than a 16th of a shard's bytes
    large = groups.where(F.col("bytes") > part_bytes).select("h", F.ceil(F.col("bytes") / part_bytes).cast("int").alias("parts"))
    dealt = meta.join(F.broadcast(large), "h", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    items = dealt.groupBy("h", "part").agg(F.sum("size").alias("w"), F.min(F.struct("id", *[f"d{i}" for i in range(len(dims))])).alias("x"))
    keys = []
    tie = F.shiftrightunsigned(F.xxhash64("h", "part"), 64 - STEPS)
    for i in range(max(1, len(dims))):
        lo, hi = (ends[2 * i], ends[2 * i + 1]) if dims else (None, None)
        place = F.lit(0) if lo is None or lo == hi else F.coalesce(1 + ((F.col(f"x.d{i}") - lo) / (hi - lo) * ((1 << STEPS) - 2)).cast("long"), F.lit(0))
        items = items.withColumn(f"k{i}", F.shiftleft(place.cast("long"), STEPS) + tie)
        keys.append(f"k{i}")
    items = materialise(items.select("h", "part", "w", F.lit(0).alias("node"), *keys), "shard-items")
    level = [Node(0, shards)] if n else []
    while level := [x for x in level if x.shards > 1]:
        above, items = items, split_level(items, len(keys), level)
        discard(above)
        level = [half for x in level for half in x.halves()]
    placed = items.select("h", "part", F.col("node").alias("shard"))
    rows = dealt.join(placed, ["h", "part"]).select("id", "size", "crc", "h", "shard", F.pmod(F.xxhash64("row"), F.lit(max(1, n // (shards * SLOT_ROWS)))).alias("lot"))
    rows = materialise(rows, "shard-placed")
    discard(meta, items)
    lots = rows.groupBy("shard", "lot").agg(F.count("*").alias("n"))
    before = lots.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("lot")) - F.col("n")).drop("n")
    slots = rows.withColumn("own", F.row_number().over(Window.partitionBy("shard", "lot").orderBy("id", "h")) - 1).join(before, ["shard", "lot"])
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("own") + F.col("before")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = DIMENSIONS) -> None:
    """Writes ``docs`` under ``path``, a folder for each shard. Rows of one id and text go together."""
    crc, at, slot = (fresh(c, docs.columns) for c in ("text_crc32", "shard", "slot"))
    placed = shard(docs, shards, id_col, text_col, dimensions).groupBy(F.col(id_col).alias("placed_id"), F.col("text_crc32").alias(crc)).agg(F.min("shard").alias(at), F.min("slot").alias(slot))
    own = docs.withColumn(crc, F.coalesce(F.crc32(F.encode(F.col(text_col), "utf-8")), F.lit(0)))
    joined = own.join(placed, F.col(id_col).eqNullSafe(F.col("placed_id")) & (own[crc] == placed[crc])).drop("placed_id", crc)
    joined.repartition(at).sortWithinPartitions(at, slot).write.partitionBy(at).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(text_frame(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
