"""Ranks in bins, medians by bits, numbered lines, imports, collections, chunk tables, outcomes of comparisons."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from evalloom.operators import experiments as X
from evalloom.operators import imports, listing, passages, reports
from evalloom.operators.collections import Collections
from evalloom.sources.tables import front_matter, numbered_lines


def test_bits_have_the_order_of_doubles(spark):
    import struct

    random.seed(1)
    values = [0.0, 5e-324, 1e-310, 2.0**-1022, 1.0, math.nextafter(1, 2), math.nextafter(2, 1), 2.0, 3.5, 1e300, math.inf, 0.1 + 0.2, 0.3] + [random.uniform(0, 1) * 10 ** random.randint(-200, 200) for _ in range(300)]
    values += [-v for v in values]
    out = spark.createDataFrame([(v,) for v in values], "v double").select("v", reports.ordered_bits(F.col("v")).alias("k")).collect()
    for r in out:
        bits = struct.unpack(">q", struct.pack(">d", abs(r.v)))[0]
        assert r.k == (-bits if r.v < 0 else bits), r.v


def brute_ranks(ds):
    some = sorted(abs(d) for d in ds if d)
    rank = {s: some.index(s) + (some.count(s) + 1) / 2 for s in set(some)}
    return len(some), sum(rank[abs(d)] for d in ds if d > 0)


def test_ranks_in_bins(spark):
    random.seed(2)
    groups = {g: [random.choice([-1, 1]) * random.choice([random.random() * 10 ** random.randint(-6, 6), 0.5, 0.0, 1 + random.random() * 1e-9]) for _ in range(150)] for g in ("a", "b", None)}
    out = {r.g: r for r in reports.signed_ranks(spark.createDataFrame([(g, d) for g, ds in groups.items() for d in ds], "g string, d double"), ["g"]).collect()}
    for g, ds in groups.items():
        assert (out[g].n, out[g].w_plus) == brute_ranks(ds)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 200])
def test_median(spark, n):
    random.seed(n)
    values = [random.choice([random.gauss(0, 1), 1.0, random.random() * 1e-9, -5.5]) for _ in range(n)]
    df = spark.createDataFrame([*((v,) for v in values), (None,), (math.nan,)], "v double")
    assert reports.exact_median(df, "v").first().median == (statistics.median(values) if values else None)


def test_score_noise(spark):
    out = reports.score_noise(spark.createDataFrame([(0.5,), (-0.1,), (0.2,)], "d double"), "d").first()
    assert (out.pairs, out.max_delta, out.median_delta) == (3, 0.5, 0.2)


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    random.seed(4)
    files = {"a.txt": ["x" * random.randint(0, 300) for _ in range(200)], "b.txt": ["one\r", "", "  ", "last"], "c.txt": []}
    for name, lines in files.items():
        (tmp_path / name).write_bytes("\n".join(lines).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = numbered_lines(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() > 2
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in out.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted((n, i, x.rstrip("\r")) for n, lines in files.items() for i, x in enumerate(lines, 1))


def test_import_reports_all_that_is_wrong(spark):
    lines = [
        '{"qid": " q1 ", "question": "a?", "gold_anchors": [{"doc": "d", "span": "s"}], "notes": " "}',
        "",
        "not json",
        "[]",
        '{"qid": "", "difficulty": "hard", "gold_anchors": {"doc": "d"}}',
        '{"qid": "q1", "question": "again", "gold_anchors": [{"doc": "gone"}]}',
        '{"qid": "q2", "question": "b?", "gold_anchors": [{"doc": "d"}, {"doc": " "}, {"span": "s"}]}',
        '{"qid": "old", "question": "b?"}',
        '{"qid": "q3", "question": "' + "x" * imports.LINE_BYTES + '"}',
        '{"qid": "q4", "question": "c?", "gold_anchors": null, "difficulty": "中"}',
    ]
    df = spark.createDataFrame([("f", n, v) for n, v in enumerate(lines, 1)], "file string, line long, value string")
    out = imports.checked(imports.parsed(df), spark.createDataFrame([("old",)], "qid string"), spark.createDataFrame([("d",)], "doc string"))
    rows = {r.line: r for r in out.collect()}
    assert {n: r.errors for n, r in rows.items()} == {1: [], 3: ["no JSON object"], 4: ["no JSON object"], 5: ["no qid", "no question", "bad difficulty", "anchors aren't a list"], 6: ["repeated qid", "no such document: gone"], 7: ["anchor without doc: 1,2"], 8: ["stored qid"], 9: ["line too long"], 10: []}
    assert rows[1].qid == "q1" and rows[1].notes is None and rows[10].difficulty == "中"
    assert imports.totals(out).first()[1:] == (9, 2, 7)
    assert imports.refused(out).count() == 11


def test_front_matter(spark):
    text = "---\ndoc_id: A01\ntitle: A title\nmodule: m\ntags: [one, 'two', three four]\nversion: 1\n---\n# Head\nbody\n"
    out = front_matter(spark.createDataFrame([(text,), ("no header",)], "value string")).collect()
    assert (out[0].doc_id, out[0].title, out[0].tags, out[0].raw_text) == ("A01", "A title", ["one", "two", "three four"], "# Head\nbody\n")
    assert out[1].doc_id is None and out[1].tags == [] and out[1].raw_text == "no header"


def test_collections(spark, tmp_path):
    c = Collections(spark, str(tmp_path), buckets=2)
    points = lambda *xs: spark.createDataFrame([(i, list(v), "p") for i, v in xs], "point_id string, embedding array<double>, payload string")
    assert not c.exists("one") and c.names() == []
    with pytest.raises(LookupError):
        c.dims("one")
    c.ensure("one", 2)
    c.ensure("one", 2)
    assert c.info("one").first().asDict() == {"name": "one", "dims": 2, "points": 0}
    c.upsert("one", points(("a", (1.0, 2.0)), ("b", (3.0, 4.0))))
    c.upsert("one", points(("a", (9.0, 9.0)), ("c", (5.0, 6.0))))
    assert sorted((r.point_id, r.embedding) for r in c.read("one").collect()) == [("a", [9.0, 9.0]), ("b", [3.0, 4.0]), ("c", [5.0, 6.0])]
    for bad in (points(("d", (1.0,))), points(("d", (1.0, 2.0))).withColumn("embedding", F.lit(None).cast("array<double>"))):
        with pytest.raises(ValueError, match="2 entries"):
            c.upsert("one", bad)
    with pytest.raises(ValueError, match="2 entries, not 3"):
        c.ensure("one", 3)
    c.ensure("one", 3, recreate=True)
    assert c.info("one").first().points == 0 and c.dims("one") == 3 and c.names() == ["one"]
    assert c.delete("one") and not c.delete("one") and not c.exists("one")


@pytest.mark.parametrize(("raw", "config", "spans"), [
    ("para one\nstill\n\n\npara two\n", ("paragraph", 50, 0, 1), [(0, 15), (17, 26)]),
    ("ab\n\ncd\n\n" + "e" * 30, ("paragraph", 100, 0, 10), [(0, 38)]),
    ("e" * 30 + "\n\nab", ("paragraph", 100, 0, 10), [(0, 34)]),
    ("a" * 12 + "\n\n" + "b" * 12 + "\n\n" + "c" * 3, ("paragraph", 20, 4, 16), [(0, 13), (14, 31)]),
    ("x" * 25, ("paragraph", 10, 2, 1), [(0, 10), (8, 18), (16, 25)]),
    (" \n\n", ("paragraph", 10, 2, 1), []),
    ("", ("headings", 10, 2, 1), []),
])
def test_paragraph_chunks(raw, config, spans):
    out = passages.chunk(raw, *config)
    assert [(c["char_start"], c["char_end"]) for c in out] == spans and all(raw[c["char_start"] : c["char_end"]] == c["text"] for c in out)


def test_short_sections_keep_the_first_title():
    out = passages.chunk("intro\n# A\nshort\n## B\n" + "long " * 30 + "\n# C\nend\n", least=80)
    assert [(c["section"], c["char_start"]) for c in out] == [("", 0)]


@pytest.mark.parametrize("config", [("words", 10, 2, 1), ("fixed", 0, 0, 1), ("fixed", 10, 10, 1), ("fixed", 10, -1, 1), ("fixed", 10, 1, -1)])
def test_bad_chunking(spark, config):
    with pytest.raises(ValueError, match="bad chunking"):
        passages.chunk("x", *config)
    with pytest.raises(ValueError, match="bad chunking"):
        passages.chunk_rows(spark.createDataFrame([("x",)], "text string"), "text", *config)


def test_chunk_tables_agree(spark):
    docs = spark.createDataFrame([(1, "# A\n" + "word " * 300 + "\n\nend", "k"), (2, None, "k"), (3, "", None)], "doc_id long, text string, index string")
    passages.register_functions(spark)
    rows = passages.chunk_rows(docs.drop("index")).collect()
    table = spark.sql("select d.doc_id, c.* from {d} d, lateral document_chunks(d.text, 'headings', 500, 50, 80) c", d=docs.drop("index")).collect()
    listed = passages.chunked(docs.drop("index")).select("doc_id", F.inline("chunks")).select("doc_id", "index", "text", "char_start", "char_end", "section").collect()
    assert len(rows) > 2 and sorted(map(tuple, rows)) == sorted(map(tuple, table)) == sorted(map(tuple, listed))


def run(name, **more):
    return {"run_id": name, "config_hash": "h", "dataset_id": 1, "corpus_id": 1, "status": "succeeded", "metrics": {"recall": 0.5}} | more


RUN = "struct<run_id:string,config_hash:string,dataset_id:int,corpus_id:int,status:string,metrics:map<string,double>>"
CASE = "run_id string, qid string, metrics map<string,double>, flags array<string>, ids array<string>"


@pytest.mark.parametrize(("other", "case", "strict", "code", "reasons"), [
    ({}, {}, False, 0, []),
    ({"metrics": {"recall": 0.5 + 1e-12}}, {}, True, 0, []),
    ({"metrics": {"recall": 0.6}}, {}, False, 1, []),
    ({"metrics": {"recall": 0.5, "mrr": 1.0}}, {}, False, 1, []),
    ({}, {"metrics": {"hits": 2.0}}, False, 1, []),
    ({}, {"flags": ["x"]}, False, 1, []),
    ({}, {"ids": ["b", "a"]}, False, 0, []),
    ({}, {"ids": ["b", "a"]}, True, 1, []),
    ({}, {"qid": "q9"}, False, 1, []),
    ({"config_hash": "other"}, {}, False, 2, ["config"]),
    ({"config_hash": "other", "corpus_id": 3, "status": "failed"}, {}, False, 2, ["config", "data"]),
    ({"dataset_id": 2}, {}, False, 2, ["data"]),
    ({"status": "running"}, {}, False, 2, ["status"]),
])
def test_outcomes(spark, other, case, strict, code, reasons):
    base = {"qid": "q1", "metrics": {"hits": 1.0}, "flags": [], "ids": ["a", "b"]}
    rows = [("l", *base.values()), ("r", *(base | case).values())]
    pairs = spark.createDataFrame([(1, run("l"), run("r", **other), strict)], f"pair int, left {RUN}, right {RUN}, strict boolean")
    out = X.consistency_outcomes(pairs, spark.createDataFrame(rows, CASE)).first()
    assert (out.exit_code, out.reasons) == (code, reasons)
    if code == 2:
        assert (out.case_diffs, out.only_in_left, out.run_differences) == (0, 0, [])


def test_ignored_keys(spark):
    pairs = spark.createDataFrame([(1, run("l", metrics={"tokens": 1.0}), run("r", metrics={"tokens": 2.0}), False)], f"pair int, left {RUN}, right {RUN}, strict boolean")
    cases = spark.createDataFrame([], CASE)
    assert [X.consistency_outcomes(pairs, cases, ignored=i).first().run_differences for i in ((), ("tokens",))] == [["tokens"], []]


def test_k_of_a_replay(spark):
    metric = "struct<gold_count:long,retrieved_count:long,hits:long,recall:double,hit:double,first_hit_rank:long>"
    judge = "struct<claims:long,unsupported:long,irrelevant:long,relevance:long,helpfulness:long>"
    m = lambda n, rank: {"gold_count": 1, "retrieved_count": n, "hits": None, "recall": 1.0, "hit": 1.0, "first_hit_rank": rank}
    rows = [(1, "a", m(5, 2), None, None), (2, "a", m(5, 3), None, []), (2, "b", m(9, 5), None, ["retrieval_miss"]), (3, "a", m(None, 3), None, []), (4, "a", None, {"claims": 2, "unsupported": 1, "irrelevant": 0, "relevance": None, "helpfulness": None}, ["no_gold"])]
    out = {(r.run_id, r.qid): r for r in X.replayed(spark.createDataFrame(rows, f"run_id int, qid string, metrics {metric}, judge {judge}, flags array<string>"), spark.createDataFrame([(1, 2), (2, 0), (3, None), (4, 5)], "run_id int, top_k int")).collect()}
    assert {k: (r.k, r.new_flags, r.changed) for k, r in out.items()} == {(1, "a"): (2, ["retrieval_low_rank"], True), (2, "a"): (9, [], False), (2, "b"): (9, [], True), (3, "a"): (5, [], False), (4, "a"): (5, ["no_gold", "hallucination"], True)}


def test_one_takes_every_value(spark):
    df = spark.createDataFrame([(0, ""), (5, "x"), (None, None)], "id long, name string")
    assert [r.id for r in listing.one(df, id=5).collect()] == [5] and listing.one(df.where("id = 5"), id=0).count() == 0
    assert listing.one(df, name="").first().id == 0 and listing.one(df, id=None).count() == 1 and listing.one(df.where("id = 5"), id=None).count() == 0


def test_flags_of_unknown_names_come_last(spark):
    out = spark.range(1).select(X.ordered_flags(F.array(*map(F.lit, ("zzz", "off_topic", "no_gold", "aaa")))).alias("f")).first().f
    assert out == ["no_gold", "off_topic", "zzz", "aaa"]


def test_a_corpus_indexed_again_is_the_same(spark, tmp_path):
    from evalloom.operators import indexing

    assert indexing.chunking_hash()[:8] == "5f45e034"
    c = Collections(spark, str(tmp_path), buckets=2)
    docs = spark.createDataFrame([(1, "# A\n" + "word " * 300), (2, "short"), (3, None), (4, " ")], "doc long, text string")
    name, report = indexing.index_corpus(c, 3, docs, "6ba7b8109dad11d180b400c04fd430c8", dims=32)
    first = sorted((r.point_id, r.doc, r["index"], tuple(r.embedding)) for r in c.read(name).collect())
    row = report.first()
    assert name == "corpus3_5f45e034" and (row.docs, row.chunks, row.points, row.calls) == (4, 5, 5, 1)
    indexing.index_corpus(c, 3, docs, "6ba7b8109dad11d180b400c04fd430c8", dims=32)
    assert sorted((r.point_id, r.doc, r["index"], tuple(r.embedding)) for r in c.read(name).collect()) == first and c.info(name).first().points == 5
    with pytest.raises(ValueError, match="32 entries, not 16"):
        indexing.index_corpus(c, 3, docs, "6ba7b8109dad11d180b400c04fd430c8", dims=16)


def test_keys_of_json(spark):
    from evalloom.operators import usage

    values = ['{"rubric": null}', '{"rubric": {"relevance": 1}}', '{"rubric": "null"}', "{}", "[]", "broken", None, '{"other": 1}']
    out = spark.createDataFrame([(v,) for v in values], "judge string")
    assert [(r.k, r.v) for r in out.select(usage.has_key(F.col("judge"), "rubric").alias("k"), usage.has_value(F.col("judge"), "rubric").alias("v")).collect()][:2] == [(True, False), (True, True)]
    assert usage.rubric_counts(out).first().rubric_cases == 3


def test_parts_of_a_folder_are_numbered_as_one_file(spark, tmp_path):
    for folder, name, lines in (("a", "part-0.txt", "x\ny\n"), ("a", "part-1.txt", "z\n"), ("b", "part-1.txt", "u\n")):
        (tmp_path / f"source={folder}").mkdir(exist_ok=True)
        (tmp_path / f"source={folder}" / name).write_text(lines)
    out = numbered_lines(spark, str(tmp_path), parts=True)
    assert sorted((r.file[-1], r.line, r.value) for r in out.collect()) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "u")]


def test_a_source_is_written_by_many_tasks(spark, tmp_path):
    from evalloom.plans import chunks

    spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    with_aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[0] for r in chunks.case_lines(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_aqe)
    assert max(sizes) < 3000 and sum(sizes) == 4000
    assert chunks.import_totals(spark, str(tmp_path)).first().total == 3800


def test_texts_are_cut_in_slices():
    import pyarrow as pa

    texts = ["a" * 700_000, None, "b" * 700_000, "c" * 3_000_000, "", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["n", "t"])
    got = [(part.column(0).to_pylist(), [len(t) for t in of]) for part, of in passages.slices(iter([batch, batch.slice(0, 0)]), 1)]
    assert got == [([0, 1], [700_000, 0]), ([2], [700_000]), ([3], [3_000_000]), ([4, 5], [0, 1])]
