"""Keyed tables and the stateful queue: repeated batches, cases that come twice, failures, dead letters, lost workers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalloom.operators import state
from evalloom.streaming import leases
from evalloom.streaming.keyed import KeyedTable, drain_into

KEYS = ["run_id", "case_id"]
SCHEMA = "run_id long, case_id long, answer string, at long"


def rows(spark, table):
    return sorted((r.case_id, r.answer) for r in table.read(spark.createDataFrame([], SCHEMA).schema).collect())


def test_a_case_in_two_batches_leaves_one_row(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), KEYS, buckets=3)
    batch = lambda *xs: spark.createDataFrame([(1, c, a, n) for c, a, n in xs], SCHEMA)
    assert rows(spark, t) == []
    t.merge(batch((1, "a", 1), (2, "b", 1), (3, "c", 1)), 0)
    t.merge(batch((2, "B", 2), (4, "d", 2)), 1)
    t.merge(batch((2, "B", 2), (4, "d", 2)), 1)
    t.merge(batch((1, "late", 0)).limit(0), 2)
    assert rows(spark, t) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    t.merge(batch((1, "z", 9)), 3)
    assert rows(spark, t) == [(1, "z"), (2, "B"), (3, "c"), (4, "d")]
    before = rows(spark, t)
    assert t.vacuum() >= 1 and rows(spark, t) == before


def test_half_written_batches_do_not_count(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), KEYS, ["at"], buckets=2)
    one = spark.createDataFrame([(1, 1, "old", 1), (1, 1, "new", 2), (1, 2, "x", 1)], SCHEMA)
    t.merge(one, 0)
    t.merge(one.withColumn("answer", F.lit("broken")).withColumn("at", F.lit(9).cast("long")), 1)
    (tmp_path / "buckets-2" / "batch=1" / "_SUCCESS").unlink()
    assert rows(spark, t) == [(1, "new"), (2, "x")]
    t.merge(spark.createDataFrame([(1, 1, "again", 3), (1, 2, "older", 0)], SCHEMA), 1)
    assert rows(spark, t) == [(1, "again"), (2, "x")]


def test_a_stream_that_starts_again_keeps_one_row_a_case(spark, tmp_path):
    pending, check = str(tmp_path / "in"), str(tmp_path / "check")
    t = KeyedTable(spark, str(tmp_path / "out"), KEYS, ["at"], buckets=2)
    for n in range(3):
        spark.createDataFrame([(1, c, f"a{n}", n) for c in range(n, 4)], SCHEMA).write.mode("append").parquet(pending)
        drain_into(t, pending, SCHEMA, check, lambda df: df, files_each=1)
    assert rows(spark, t) == [(0, "a0"), (1, "a1"), (2, "a2"), (3, "a2")]
    query = drain_into(t, pending, SCHEMA, check, lambda df: df, seconds=0.2)
    spark.createDataFrame([(1, 0, "polled", 9)], SCHEMA).write.mode("append").parquet(pending)
    query.processAllAvailable()
    query.stop()
    assert rows(spark, t)[0] == (0, "polled")


@pytest.mark.parametrize(("status", "retries", "kind", "after"), [(None, 0, "enqueue", ("pending", 0)), ("pending", 1, "claim", ("running", 1)), ("running", 1, "failed", ("pending", 2)), ("running", 2, "failed", ("failed", 3)), ("running", 2, "done", ("succeeded", 2)), ("running", 1, "abort", ("pending", 1)), ("succeeded", 0, "failed", None), ("failed", 3, "claim", None), ("pending", 0, "enqueue", None)])
def test_steps(status, retries, kind, after):
    assert leases.step(status, retries, kind, 3) == after


def test_stateful_queue(spark, tmp_path):
    for key, value in leases.STORE.items():
        spark.conf.set(key, value)
    t = KeyedTable(spark, str(tmp_path / "items"), ["job_id", "case_id"], ["nth"], buckets=2)
    stream = [
        [(1, c, "enqueue", None, 0) for c in range(4)] + [(1, c, "claim", None, 1) for c in range(3)] + [(1, 0, "done", None, 2), (1, 1, "failed", "x" * 900, 2)],
        [(1, 1, "claim", None, 3), (1, 1, "failed", "second", 4), (1, 1, "claim", None, 5), (1, 1, "failed", "third", 6), (2, 7, "enqueue", None, 0), (2, 7, "claim", None, 6), (3, 8, "enqueue", None, 5), (3, 8, "claim", None, 6), (3, None, "abort", "fatal", 7)],
        [(2, None, "beat", None, 50), (1, None, "beat", None, 8)],
        [(9, 0, "enqueue", None, 100)],
        [(9, 1, "enqueue", None, 101)],
        [(9, 2, "enqueue", None, 102)],
    ]
    seen = []
    for part in stream:
        spark.createDataFrame([(j, c, k, e, n) for j, c, k, e, n in part], "job_id long, case_id long, kind string, error string, n long").select("job_id", "case_id", "kind", "error", F.timestamp_seconds(F.col("n") + 1_000_000).alias("at"), F.col("n").alias("seq")).write.mode("append").parquet(str(tmp_path / "in"))
        drain_into(t, str(tmp_path / "in"), leases.EVENTS, str(tmp_path / "check"), lambda df: leases.items(df, late="10 seconds", shards=2))
        seen.append({(r.job_id, r.case_id): r for r in t.read(spark.createDataFrame([], leases.ITEMS).schema).collect()})
    status = lambda n: {k: r.status for k, r in seen[n].items() if k[0] < 9}
    assert status(0) == {(1, 0): "succeeded", (1, 1): "pending", (1, 2): "running", (1, 3): "pending"} and len(seen[0][1, 1].last_error) == 500
    assert status(1)[1, 1] == "failed" and seen[1][1, 1].retry_count == 3 and status(1)[3, 8] == "pending" and seen[1][3, 8].cause == "abort"
    # job 1's worker is gone after second 8, job 2's beat at second 50
    assert (status(5)[1, 2], seen[5][1, 2].cause, status(5)[2, 7]) == ("pending", "stale", "running")
    done = seen[5][1, 1]
    batch = state.retried(spark.createDataFrame([(1, "running", 2, None)], "case_id long, status string, retry_count int, last_error string"), spark.createDataFrame([(1, "third")], "case_id long, error string")).first()
    assert (batch.status, batch.retry_count, batch.last_error) == (done.status, done.retry_count, done.last_error)


def test_a_shard_is_one_call_to_the_store(spark):
    calls = []

    class Value:
        """A value of the state that counts what is asked of it."""

        kept = None

        def exists(self):
            calls.append("exists")
            return self.kept is not None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, value):
            calls.append("update")
            self.kept = value

    class Handle:
        def getValueState(self, *_):
            return Value()

        def listTimers(self):
            return []

        def registerTimer(self, at):
            calls.append(at)

    queue = leases.Leases(1000, 3)
    queue.init(Handle())
    batch = lambda *kinds: iter([pd.DataFrame([(c, False, k, None, n, n) for c in range(500) for n, k in enumerate(kinds)], columns=["case_id", "whole", "kind", "error", "at_ms", "seq"])])
    (out,) = queue.handleInputRows((1, 0), batch("enqueue", "claim", "failed", "claim"), None)
    assert len(out) == 500 and set(out.status) == {"running"} and set(out.retry_count) == {1} and len(calls) == 3
    (out,) = queue.handleInputRows((1, 0), batch("done"), None)
    assert set(out.status) == {"succeeded"} and out.nth.nunique() == 500 and out.nth.min() > 4 * 499 and len(calls) == 7


def test_a_batch_of_a_stream_is_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    spark.createDataFrame([(1, c, "a", 0) for c in range(10)], SCHEMA).write.parquet(str(tmp_path / "in"))
    t = KeyedTable(spark, str(tmp_path / "out"), KEYS, ["at"], buckets=2)

    def noted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    for n in range(2):
        drain_into(t, str(tmp_path / "in"), SCHEMA, str(tmp_path / "check"), lambda df: df.mapInPandas(noted, SCHEMA))
        if not n:
            spark.createDataFrame([(1, c, "b", 1) for c in range(5)], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    assert seen.value == 15 and [a for _, a in rows(spark, t)] == ["b"] * 5 + ["a"] * 5


def test_aborted_jobs(spark):
    items = spark.createDataFrame([(1, 1, "running"), (1, 2, "succeeded"), (2, 3, "running")], "job_id long, case_id long, status string")
    jobs = spark.createDataFrame([(1, "running")], "job_id long, status string")
    i, j = state.aborted(items, jobs)
    assert {r.case_id: r.status for r in i.collect()} == {1: "pending", 2: "succeeded", 3: "running"} and [r.status for r in j.collect()] == ["failed"]
