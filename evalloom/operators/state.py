"""Results kept up to date: upserts, merges, patches, queue progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return history.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row written for each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return history.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged(history: DataFrame, keys: list[str], order: Column, fields: list[str]) -> DataFrame:
    """Field by field the latest value that isn't null."""
    return history.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields))


def patched(old: Column, sent: Column) -> Column:
    """A score after a patch: null keeps it, 0 clears it, anything else sets it."""
    return F.when(sent.isNull(), old).when(sent == 0, F.lit(None)).otherwise(sent)


def progress(items: DataFrame, job: str, status: str) -> DataFrame:
    """Counts by status and in total for each job."""
    return items.groupBy(job).agg(*(F.count_if(F.col(status) == s).alias(s) for s in ("pending", "running", "succeeded", "failed")), F.count("*").alias("total"))


def stale(jobs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Running jobs without a heartbeat in the last seconds."""
    return jobs.where((F.col("status") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < now - F.make_interval(secs=F.lit(seconds)))))


def pending(cases: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return cases.join(results, keys, "left_anti")


def enqueued(cases: DataFrame, run_id: int, first_id: int = 1) -> DataFrame:
    """The queue's items of a new run: one for each case, pending. Fails without cases."""
    if cases.isEmpty():
        raise ValueError("no cases to run")
    return cases.select(F.lit(run_id).alias("run_id"), "case_id", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("last_error"))


def claimed(items: DataFrame, n: int, most: int = 500, default: int = 50, job: str = "job_id", key: str = "case_id") -> DataFrame:
    """``items`` with the first ``n`` pending ones of each job running."""
    n = n if 0 < n <= most else default
    place = F.row_number().over(Window.partitionBy(job, "status").orderBy(key))
    return items.withColumn("_n", place).withColumn("status", F.when((F.col("status") == "pending") & (F.col("_n") <= n), "running").otherwise(F.col("status"))).drop("_n")


def retried(items: DataFrame, failures: DataFrame, key: str = "case_id", most: int = 3, error_chars: int = 500) -> DataFrame:
    """``items`` after failures (key, error): pending again, or failed from the ``most``-th time on."""
    out = items.join(failures.select(key, F.col("error").alias("_error")), key, "left")
    hit = F.col("_error").isNotNull()
    times = F.col("retry_count") + F.when(hit, 1).otherwise(0)
    out = out.withColumn("status", F.when(hit, F.when(times >= most, "failed").otherwise("pending")).otherwise(F.col("status")))
    return out.withColumn("retry_count", times).withColumn("last_error", F.when(hit, F.substring("_error", 1, error_chars)).otherwise(F.col("last_error"))).drop("_error")


def released(items: DataFrame, which: DataFrame | None = None, key: str = "case_id") -> DataFrame:
    """``items`` with running ones pending again: those of ``which``, or all."""
    if which is None:
        return items.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))
    out = items.join(which.select(key).distinct().withColumn("_own", F.lit(True)), key, "left")
    return out.withColumn("status", F.when((F.col("status") == "running") & F.col("_own"), "pending").otherwise(F.col("status"))).drop("_own")


def releasable(jobs: DataFrame, items: DataFrame, job: str = "job_id") -> DataFrame:
    """Running jobs without a running item."""
    return jobs.where(F.col("status") == "running").join(items.where(F.col("status") == "running"), job, "left_anti")


def reclaimed(items: DataFrame, stale_jobs: DataFrame, job: str = "job_id") -> DataFrame:
    """``items`` with the running ones of jobs whose worker is gone pending again."""
    out = items.join(stale_jobs.select(job).distinct().withColumn("_stale", F.lit(True)), job, "left")
    return out.withColumn("status", F.when((F.col("status") == "running") & F.col("_stale"), "pending").otherwise(F.col("status"))).drop("_stale")


def finished(items: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, status): failed if an item is dead or unfinished, else succeeded."""
    return items.groupBy(job).agg(F.when(F.count_if(F.col("status") != "succeeded") > 0, "failed").otherwise("succeeded").alias("status"))


def aborted(items: DataFrame, jobs: DataFrame, job: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """Items and jobs after a fatal error of ``jobs``: running items pending again, the jobs failed."""
    return reclaimed(items, jobs, job), jobs.withColumn("status", F.lit("failed"))


def upserted(stored: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``news`` in place of those with their keys."""
    return stored.join(news, keys, "left_anti").unionByName(news)
