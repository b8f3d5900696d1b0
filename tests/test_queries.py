"""Each query beside its SQL, on the smallest tables; values known by hand."""

import json
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalloom.functions import scoring as S
from evalloom.operators import passages, reports, retrieval, state
from evalloom.plans import catalog

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def rows(df):
    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return round(float(v), 6) if hasattr(v, "__float__") else str(v)

    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_case_metrics_by_hand(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid long")
    found = spark.createDataFrame([(1, v, r) for r, v in enumerate((8, 10, 9, 20, 7), 1)] + [(2, 5, 1), (4, 5, 1)], "qid long, vec_id long, rank int")
    gold = spark.createDataFrame([(1, 10), (1, 20), (2, 6), (3, 1)], "qid long, vec_id long")
    out = {r.qid: r for r in retrieval.case_metrics(cases, found, gold, 5).collect()}
    assert (out[1].recall, out[1].precision, out[1].reciprocal_rank, out[1].first_hit_rank) == (1.0, 0.4, 0.5, 2)
    assert (out[2].recall, out[2].reciprocal_rank, out[2].first_hit_rank) == (0.0, 0.0, None)
    assert out[4].recall is None and out[4].gold_count == 0


def test_low_rank_limit():
    assert [S.low_rank_limit(k) for k in (1, 3, 5, 10)] == [1, 2, 3, 5]


@pytest.mark.parametrize(("values", "w", "p"), [([1.0, 2, 3, 4, 5], 15.0, 0.0625), ([2.0, -2, 5], 4.5, None), ([1.0, 2, 3, 4, 5, 0], 15.0, 0.0625)])
def test_signed_ranks_by_hand(spark, values, w, p):
    d = spark.createDataFrame([("g", float(v)) for v in values], "g string, d double")
    assert reports.signed_ranks(d, ["g"]).first().w_plus == w
    if p:
        assert reports.exact_p(d, ["g"]).first().p == p


def test_every_group_has_a_p(spark):
    groups = {"many": [float(i) for i in range(1, 31)], "even": [float(i * (-1) ** i) for i in range(1, 41)], "few": [1.0, 2.0, 3.0, 4.0, 5.0], "none": [0.0, 0.0], None: [1.0, 2.0]}
    d = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, d double")
    out = {r.g: r for r in reports.exact_p(d, ["g"]).collect()}
    assert set(out) == set(groups)
    assert (out["many"].n, out["many"].w_plus) == (30, 465.0) and out["many"].p < 1e-5
    # z = (420 - 410 - 0.5) / sqrt(5535)
    assert out["even"].w_plus == 420.0 and abs(out["even"].p - 0.898392) < 2e-6
    assert (out["few"].p, out["none"].p, out["none"].n, out[None].p) == (0.0625, 1.0, 0, 0.5)


def test_kappa_by_hand(spark):
    k = lambda *x: spark.range(1).select(S.kappa(*(F.lit(float(v)) for v in x)).alias("k")).first().k
    assert round(k(40, 10, 40, 10), 9) == 0.6
    assert k(10, 0, 0, 0) == 0.0


def test_patch_and_upsert(spark):
    out = spark.range(1).select(*(state.patched(F.lit(4), F.lit(v).cast("int")).alias(n) for n, v in (("keep", None), ("clear", 0), ("set", 2)))).first()
    assert tuple(out) == (4, None, 2)


def test_chunks():
    raw = "# A\n" + "one\n" * 30 + "## B\n" + "two\n" * 30 + "## C\n" + "three\n" * 30
    out = passages.chunk(raw, size=500, overlap=0, least=1)
    assert [c["section"] for c in out] == ["A", "A / B", "A / C"]
    assert all(raw[c["char_start"] : c["char_end"]] == c["text"] for c in out)
    long = passages.chunk("x" * 120, "fixed", 50, 20)
    assert long[-1]["char_end"] == 120 and all(b["char_start"] == a["char_end"] - 20 for a, b in zip(long, long[1:], strict=False))


def test_context_packs_whole_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = {}
    for r in catalog.retrieved(spark, DATA, 64, 5).orderBy("qid", "rank").collect():
        t = texts.get(r.vec_id, "")
        found.setdefault(r.qid, []).extend([t[s : s + 500] for s in range(0, max(len(t) - 500, 0) + 450, 450)][: max(1, -(-(len(t) - 500) // 450) + 1)] if t else [])
    out = {r.qid: r for r in catalog.contexts(spark, DATA).collect()}
    assert set(out) == {q for q, b in found.items() if b}
    for q, r in out.items():
        used, ranks = 0, []
        for i, b in enumerate(found[q], 1):
            cost = len(b) + (2 if used else 0)
            if used + cost <= 2000:
                used, ranks = used + cost, [*ranks, i]
        assert (r.used, r.ranks) == (used, ",".join(map(str, ranks)))


def test_protocol_keeps_whole_texts(spark):
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    kept = [r for r in catalog.protocol(spark, DATA).collect() if r.error is None]
    assert kept and all(json.loads(r.claims)[0]["text"] == texts[r.conv_id, r.turn].strip(" ") for r in kept)


def test_spans_are_found_after_any_character(spark):
    span = "alpha beta gamma delta epsilon " * 12 + "end"
    items = spark.createDataFrame([(1, span), (2, " \tzeta eta theta iota kappa"), (3, "two words")], "qid long, span string")
    texts = [f'x "{span}" y', f"pre-{span}", span[:120] + " other", "a \tzeta eta theta iota kappa.", "(two words)", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    assert sorted((r.qid, r.doc) for r in passages.holding(items, docs).collect()) == [(1, 0), (1, 1), (2, 3), (3, 4)]


@pytest.mark.parametrize(("answer", "found"), [("{bad {\"a\": 1} x", '{"a": 1}'), ("", None), (None, None), ('x {"a": "}"} {"b": 2}', '{"a": "}"}')])
def test_first_object(answer, found):
    assert passages.first_object(answer) == found


def test_stream_drains_once(spark, tmp_path):
    from evalloom.streaming.queue import drain

    pending, out, check = (str(tmp_path / n) for n in ("pending", "out", "check"))
    spark.range(5).write.parquet(pending)
    for _ in range(2):
        drain(spark, pending, "id long", out, check, lambda b: b.withColumn("done", F.lit(True)))
    spark.range(5, 7).write.mode("append").parquet(pending)
    drain(spark, pending, "id long", out, check, lambda b: b.withColumn("done", F.lit(True)))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(7))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
