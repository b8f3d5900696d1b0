"""Queries over the queue as a stream and tables kept by batches; each writes its stream's files into the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators import state
from evalloom.sources.scratch import shared_folder
from evalloom.sources.tables import table
from evalloom.streaming import leases
from evalloom.streaming.keyed import KeyedTable, drain_into

Q, SQL = {}, {}
#: Most partitions of the streamed queue's state.
STATE_PARTITIONS = 32


def query(name: str, sql: str):
    def add(make):
        Q[name], SQL[name] = make, sql
        return make

    return add


def folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/evalloom-tables/{name}-{uuid.uuid4().hex}"


@query("results_sunk", "select user_id, event_type, event_id, value from events qualify event_id = max(event_id) over (partition by user_id, event_type)")
def results_sunk(s: SparkSession, d: str) -> DataFrame:
    """Results that come in four batches, the newest not last, one of them twice."""
    e = table(s, d, "events").select("user_id", "event_type", "event_id", "value")
    kept = KeyedTable(s, folder(s, "results"), ["user_id", "event_type"], ["event_id"])
    for number, part in enumerate((3, 1, 0, 2)):
        kept.merge(e.where(F.col("event_id") % 4 == part), number)
    kept.merge(e.where("event_id % 4 = 2"), 3)
    return kept.read(e.schema)


def queue_events(s: SparkSession, d: str) -> DataFrame:
    """An order is a case that fails as often as its key modulo 4 says; the workers of jobs divisible by 10 are gone after their claims."""
    job, fails = F.col("o_custkey") % 50, (F.col("o_orderkey") % 4).cast("int")
    tries = F.flatten(F.array_repeat(F.array(F.lit("claim"), F.lit("failed")), F.least(fails, F.lit(3))))
    ends = F.when(fails < 3, F.array(F.lit("claim"), F.lit("done"))).otherwise(F.array().cast("array<string>"))
    kinds = F.concat(F.array(F.lit("enqueue")), F.when(job % 10 == 0, F.array(F.lit("claim"))).otherwise(F.concat(tries, ends)))
    e = table(s, d, "orders").select(job.alias("job_id"), F.col("o_orderkey").alias("case_id"), F.posexplode(kinds).alias("seq", "kind"))
    error = F.when(F.col("kind") == "failed", F.concat(F.lit("failure "), F.col("seq").cast("string")))
    return e.select("job_id", "case_id", "kind", error.alias("error"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("seq"))).alias("at"), F.col("seq").cast("long").alias("seq"))


@query("queue_streamed", """with i as (select o_custkey % 50 job_id, o_orderkey % 4 fails from orders) select job_id, count(*) filter (job_id % 10 = 0) pending, 0::bigint running, count(*) filter (job_id % 10 <> 0 and fails < 3) succeeded,
 count(*) filter (job_id % 10 <> 0 and fails = 3) failed, count(*) total, coalesce(sum(least(fails, 3)) filter (job_id % 10 <> 0), 0)::bigint failures, count(*) filter (job_id % 10 = 0) reclaimed from i group by 1""")
def queue_streamed(s: SparkSession, d: str) -> DataFrame:
    """The stream ends and starts again twice; what is later moves its time on, until the lost workers' leases are over."""
    # the number of a state's partitions stays as it is at the first start
    before = s.conf.get("spark.sql.shuffle.partitions")
    for key, value in (leases.STORE | {"spark.sql.shuffle.partitions": str(min(int(before), STATE_PARTITIONS))}).items():
        s.conf.set(key, value)
    base = folder(s, "queue")
    kept = KeyedTable(s, f"{base}/items", ["job_id", "case_id"], ["nth"])
    late = lambda hours: s.range(1).select(F.lit(-1).cast("long").alias("job_id"), F.lit(hours).cast("long").alias("case_id"), F.lit("enqueue").alias("kind"), F.lit(None).cast("string").alias("error"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=F.lit(hours))).alias("at"), F.lit(0).cast("long").alias("seq"))
    for part in (queue_events(s, d), late(1), late(2)):
        part.write.mode("append").parquet(f"{base}/pending")
        drain_into(kept, f"{base}/pending", leases.EVENTS, f"{base}/checkpoint", leases.items)
    s.conf.set("spark.sql.shuffle.partitions", before)
    items = kept.read(s.createDataFrame([], leases.ITEMS).schema).where("job_id >= 0")
    more = items.groupBy("job_id").agg(F.sum("retry_count").cast("long").alias("failures"), F.count_if(F.col("cause") == "stale").alias("reclaimed"))
    return state.progress(items, "job_id", "status").join(more, "job_id")
