"""The durable queue as a stream: pending cases arrive as files, results are written once whatever is repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(spark: SparkSession, pending: str, schema: str, results: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Works off all files of ``pending`` there are now. Each batch has its own folder, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{results}/batch={number}")

    spark.readStream.schema(schema).parquet(pending).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event time and type, for batches and streams alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
