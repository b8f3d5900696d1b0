"""Spans found by automata and by words, approximate search, offline evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import ann, offline, passages, retrieval

SPANS = [(1, "alpha beta gamma delta epsilon zeta"), (2, "beta gamma"), (3, "x"), (4, ""), (5, "alpha beta gamma delta epsilon zeta"), (6, "never there at all in any text"), (7, None), (8, "αβγ")]
TEXTS = [(1, "say: alpha beta gamma delta epsilon zeta!"), (2, "beta gammab"), (3, ""), (4, None), (5, "αβγδ x"), (6, "alpha beta\ngamma delta epsilon zeta")]


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("block", [70, 1 << 20])
def test_spans_by_automata_and_by_words(spark, few, block):
    items, docs = spark.createDataFrame(SPANS, "qid long, span string"), spark.createDataFrame(TEXTS, "doc long, text string")
    out = passages.holding(items, docs, block, 100 if few else 0)
    expected = sorted((q, d, s) for q, s in SPANS for d, t in TEXTS if s and t and s in t)
    assert sorted(map(tuple, out.collect())) == expected and len(expected) == 6


def test_anchors_at_their_first_level(spark):
    anchors = spark.createDataFrame([(1, "d", "Exact words"), (2, "d", "exact WORDS"), (3, "d", "Title"), (4, "d", " 　"), (5, "d", "nowhere"), (6, "e", "Exact words"), (7, "d", "、。")], "qid long, doc string, span string")
    chunks = spark.createDataFrame([("d", "d:0", "A / Title", "some Exact words."), ("d", "d:1", "A", "Exact-words, again: Title")], "doc string, point string, section string, text string")
    found = sorted((r.qid, r.level, r.point) for r in passages.anchored(anchors, chunks).collect())
    assert found == [(1, 2, "d:0"), (2, 3, "d:0"), (2, 3, "d:1"), (3, 1, "d:0"), (4, 0, "d:0"), (4, 0, "d:1")]


def points(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")


def test_approximate_search_finds_most_and_indexes_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "TILE", 64)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(900)] + [(i, centres[0].tolist()) for i in range(900, 1300)]
    odd = [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [1.0] * 7)]
    df = points(spark, rows + odd)
    q = ann.fit(df, lists=40, recall=0.97)
    lists = ann.index(df, q).cache()
    assert lists.count() == 1300 and q.share < 0.7
    asked = df.where("vec_id % 50 = 0")
    found = ann.search(lists, asked, q)
    exact = retrieval.top_k(df, asked, 8, 10).select("qid", F.col("vec_id").alias("id"), "rank", "score")
    out = ann.recall(found, exact).first()
    assert out.wanted == asked.where("vec_id < 1300").count() * 10 and out.recall >= 0.9
    # with all lists probed it is the exact search
    whole = ann.search(lists, asked, q, probes=len(q.centres))
    assert sorted((r.qid, r.rank, r.id) for r in whole.collect()) == sorted((r.qid, r.rank, r.id) for r in exact.collect())


def test_approximate_search_of_nothing(spark):
    df = points(spark, [])
    q = ann.fit(df)
    assert ann.search(ann.index(df, q), df, q).count() == 0


def test_exact_search_leaves_odd_vectors_out(spark):
    df = points(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0]), (4, None), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, 0.0])])
    out = retrieval.top_k(df, df.where("vec_id in (1, 3)"), 2, 5)
    assert [(r.qid, r.vec_id, r.rank) for r in out.orderBy("qid", "rank").collect()] == [(1, 2, 1), (1, 7, 2)]


def test_documents_to_metrics(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words[20:])), (3, "Other words w1 w21")], "doc long, text string")
    cases = spark.createDataFrame([(7, "w3 w4 w5"), (8, "W25 w26"), (9, "nothing here")], "qid long, question string")
    anchors = spark.createDataFrame([(7, 1, "w3 w4 w5"), (8, 2, "w25"), (9, 3, "not there")], "qid long, doc long, span string")
    hits, metrics = offline.evaluated(docs, cases, anchors, 2, size=400, overlap=50, dims=512)
    found = {r.qid: r for r in metrics.collect()}
    assert set(found) == {"7", "8"} and all(r.recall == 1.0 and r.first_hit_rank == 1 for r in found.values())
    assert hits.count() == 4
    row = offline.report(cases, metrics, 2).first()
    assert (row.cases_total, row.cases_evaluated, row.cases_skipped_no_gold, row.recall_at_k) == (3, 2, 1, 1.0)
    assert [r.qid for r in offline.worst(metrics).collect()] == ["7", "8"] and [r.flags for r in offline.flagged(metrics, 2).collect()] == [[], []]


def test_term_vectors(spark):
    df = spark.createDataFrame([(1, "A b a\n"), (2, " "), (3, None)], "id long, text string")
    out = {r.id: r.embedding for r in offline.term_vectors(df, "id", "text", dims=16).collect()}
    assert set(out) == {1} and sorted(out[1])[-2:] == [1.0, 2.0] and sum(out[1]) == 3.0


def test_texts_are_counted_where_they_are(spark):
    df = spark.createDataFrame([(1, "a b\x0bA"), (2, " "), (3, None), (1, "c")], "id long, text string")
    out = offline.with_term_vectors(df, "text", dims=16, least=1)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(r.id, r.text, r.embedding and sum(r.embedding)) for r in out.collect()]
    assert got == [(1, "a b\x0bA", 3.0), (2, " ", None), (3, None, None), (1, "c", 1.0)]
    # texts of one id are added up
    assert {r.id: sum(r.embedding) for r in offline.term_vectors(df, "id", "text", dims=16).collect()} == {1: 4.0}


def test_copies_of_queries_grow_with_the_queries_alone(spark):
    points = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = {}
    for n in (4, 400):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        out = retrieval.top_k(points, points.where("vec_id % 10 = 0"), 2, 3)
        got[n] = (sorted(map(tuple, out.collect())), retrieval.point_groups(spark))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[4][0] == got[400][0] and got[4][1] <= got[400][1] <= 2 * spark.sparkContext.defaultParallelism < 400


def test_a_task_keeps_the_best_of_all_its_tiles(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 5)
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    points = spark.range(0, 200, 1, 1).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("embedding"))
    out = {(r.qid, r["rank"]): r.vec_id for r in retrieval.top_k(points, points.where("vec_id % 40 = 1"), 2, 4).collect()}
    same = lambda q: [v for v in range(200) if v % 7 == q % 7 and v != q][:4]
    assert out == {(q, i + 1): v for q in range(1, 200, 40) for i, v in enumerate(same(q))}


def test_a_text_without_words_leaves_the_vector_before_it_alone(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "b c")], "id long, text string").coalesce(1)
    assert [r.embedding and len(r.embedding) for r in offline.with_term_vectors(df, "text", dims=16).collect()] == [16, None, None, 16]
    assert {r.id: (len(r.embedding), sum(r.embedding)) for r in offline.term_vectors(df, "id", "text", dims=16).collect()} == {1: (16, 1.0), 4: (16, 2.0)}


def test_windows_counted_by_document_equal_windows_counted_alone(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 4)
    texts = ["one Two  three\tfour five", "ΑΣΟΣ ΟΔΟΣ. ΣΑΣ' İstanbul İI DİŞ", "a b c\x1cd   e\x85f", "x" * 40, " \n ", "", None, "é😀 " * 9, " lead and trail ", "\x0b\x0cab\rcd", "w " * 50]
    docs = spark.createDataFrame([*enumerate(texts), (None, "no name"), (20, "Z")], "doc long, text string").repartition(2)
    for size, overlap in ((7, 3), (5, 0), (2, 1), (100, 40)):
        alone = offline.with_term_vectors(offline.chunk_points(docs, size, overlap).select("point", "text"), "text", dims=16).where("embedding is not null")
        expected = {r.ids[0]: bytes(r.vectors) for r in retrieval.tiles(alone.select("point", "embedding"), 1).collect()}
        got = {}
        for r in offline.window_tiles(docs, size, overlap, 16).collect():
            got |= {name: bytes(r.vectors[i * 128:i * 128 + 128]) for i, name in enumerate(r.ids)}
        assert got == expected


def test_windows_are_not_dealt_for_few_questions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(60)], "doc long, text string").repartition(3)
    questions = offline.term_vectors(spark.createDataFrame([(f"q{i}", f"w{i} w1") for i in range(5)], "point string, text string"), "point", "text", dims=32)
    out = offline.searched(docs, questions, 3, 8, 4, 32)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    few = sorted(map(tuple, out.collect()))
    monkeypatch.setattr(offline, "FEW", 4)
    many = offline.searched(docs, questions, 3, 8, 4, 32)
    assert "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert few == sorted(map(tuple, many.collect())) and len(few) == 15


def test_results_are_merged_before_any_is_let_go(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 5)
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "HELD", 44)
    monkeypatch.setattr(retrieval, "point_groups", lambda spark: 1)
    sizes = {}
    for n in (200, 2000):
        points = spark.range(0, n, 1, 1).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("embedding"))
        asked = points.where("vec_id < 5")
        each = []
        whole = retrieval.best_of_tasks
        monkeypatch.setattr(retrieval, "best_of_tasks", lambda *a: each.append(whole(*a)) or each[0])
        out = {(r.qid, r["rank"]): r.vec_id for r in retrieval.top_k(points, asked, 2, 4).collect()}
        monkeypatch.setattr(retrieval, "best_of_tasks", whole)
        assert out == {(q, i + 1): v for q in range(5) for i, v in enumerate([v for v in range(n) if v % 7 == q % 7 and v != q][:4])}
        sizes[n] = each[0].count()
    # five queries' best four, from one task, however many tiles it saw
    assert sizes == {200: 20, 2000: 20}


def test_blocks_with_the_same_first_query_keep_their_own_floors(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 2)
    monkeypatch.setattr(retrieval, "BLOCK", 1)
    df = points(spark, [(i, [1.0, i / 10]) for i in range(12)])
    asked = points(spark, [(-1, [1.0, 0.0]), (-1, [-1.0, 0.05])]).coalesce(1)
    out = [r.vec_id for r in retrieval.top_k(df, asked, 2, 3).orderBy("rank").collect()]
    assert out == [0, 1, 2]
