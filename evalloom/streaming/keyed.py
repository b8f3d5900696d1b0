"""A table with one row a key that batches are merged into, each once whatever is repeated.

Rows live in hash buckets of their keys. A batch rewrites the buckets it touches, in a folder of its own, and counts
from the moment Spark marks that folder as whole; readers take of each bucket the newest whole version. A batch that
failed half-way leaves nothing that counts, and one that comes again after it was whole changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.sources.scratch import children, deleted, exists

BUCKET = "bucket"


class KeyedTable:
    """``order`` are columns by which the last of several rows of a key counts, in a batch and between batches; without any the later batch wins."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str] | None = None, buckets: int = 16) -> None:
        # other numbers of buckets are other tables
        self.spark, self.path, self.keys, self.order, self.buckets = spark, f"{path}/buckets-{buckets}", keys, order or [], buckets

    def _batch(self, number: int) -> str:
        return f"{self.path}/batch={number}"

    def whole(self, number: int) -> bool:
        return exists(self.spark, f"{self._batch(number)}/_SUCCESS")

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The newest whole batch of each bucket, of those before a number if it's given."""
        out: dict[int, int] = {}
        for name in children(self.spark, self.path):
            number = int(name.removeprefix("batch="))
            if (before is None or number < before) and self.whole(number):
                for part in children(self.spark, self._batch(number)):
                    if part.startswith(f"{BUCKET}="):
                        bucket = int(part.removeprefix(f"{BUCKET}="))
                        out[bucket] = max(number, out.get(bucket, number))
        return out

    def read(self, schema, only: set[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        paths = [f"{self._batch(n)}/{BUCKET}={b}" for b, n in self.versions(before).items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Puts a batch's rows in place of those with their keys."""
        if self.whole(number):
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        stored = self.versions(number)
        # rows of a batch that touches only some buckets must not bring in the others; at most as many as there are buckets
        touched = {r[0] for r in batch.select(bucket.alias(BUCKET)).distinct().collect()} if stored else set()
        both = self.read(batch.schema, touched, number).withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
        # dealt once, by bucket and part of it, so that rows meet and are written where they are
        parts = -(-2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        dealt = both.withColumns({BUCKET: bucket, "_part": F.pmod(F.hash(*self.keys), F.lit(parts))}).repartition(BUCKET, "_part")
        newest = dealt.groupBy(BUCKET, "_part", *(F.col(k).alias(f"_key_{k}") for k in self.keys)).agg(F.max_by(F.struct(*batch.columns), F.struct(*self.order, "_new")).alias("x")).select("x.*", BUCKET)
        newest.write.mode("overwrite").partitionBy(BUCKET).parquet(self._batch(number))

    def vacuum(self) -> int:
        """Deletes batches that no bucket needs any more; how many. Only for when nobody reads."""
        needed = set(self.versions().values())
        newest = max(needed, default=-1)
        old = [n for n in (int(c.removeprefix("batch=")) for c in children(self.spark, self.path)) if n not in needed and n < newest]
        return sum(deleted(self.spark, self._batch(n)) for n in old)


def drain_into(table: KeyedTable, pending: str, schema: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], files_each: int | None = None, seconds: float | None = None):
    """Works off files of ``pending`` into a keyed table: all there are now, or, with ``seconds``, whenever there are new ones, until the query that is given back is stopped."""
    reader = table.spark.readStream.schema(schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}

    def merged(batch: DataFrame, number: int) -> None:
        # kept on disk, since a stream's batch must not be worked out for its buckets and then again for its rows
        kept = batch.persist(StorageLevel.DISK_ONLY)
        try:
            table.merge(kept, number)
        finally:
            kept.unpersist()

    query = work(reader.parquet(pending)).writeStream.outputMode("update").foreachBatch(merged).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if not seconds:
        query.awaitTermination()
    return query
