"""Whole reports, their exports, previews with known fingerprints, contexts of cases."""

import pytest
from pyspark.sql import functions as F

from evalloom.operators import whole_reports as W

JUDGE = "struct<claims:long,supported:long,unsupported:long,irrelevant:long,relevance:long,helpfulness:long>"
CASE = f"qid string, category string, difficulty string, recall double, reciprocal_rank double, hit double, precision double, judge {JUDGE}, flags array<string>, n int"


def side(spark, *rows):
    """(qid, recall, flags) rows, or with claims as a fourth."""
    full = []
    for n, (qid, recall, flags, *more) in enumerate(rows):
        judge = (*more[0], None, None) if more else None
        full.append((qid, None if qid == "q3" else 'a, "b"', "易", recall, recall, float(recall > 0), recall, judge, flags, n))
    return spark.createDataFrame(full, CASE)


@pytest.fixture(scope="module")
def report(spark):
    left = side(spark, ("q1", 0.0, ["retrieval_miss"], (2, 1, 1, 0)), ("q2", 1.0, []), ("q3", 0.5, ["retrieval_partial"]), ("q4", 1.0, []), ("q1", 0.2, ["stale"]))
    right = side(spark, ("q1", 1.0, ["old"]), ("q2", 0.0, ["retrieval_miss"]), ("q3", 0.5, ["retrieval_low_rank"]), ("q4", 1.0, []), ("q1", 1.0, [], (2, 2, 0, 0)))
    return W.ab_report(left.where("n < 4"), right, right_attributed=False, order="n")


def test_the_last_of_repeated_cases_counts(report):
    assert {r.qid: r.transition for r in report.moved.collect()} == {"q1": "fixed", "q2": "broke", "q3": "changed"}
    head = report.head.first()
    assert (head.left_cases, head.right_cases, head.shared_cases, head.judged_cases, head.comparable, head.attribution_missing, head.generation_note) == (4, 4, 4, 1, True, "right", "")


def test_strata(report):
    rows = {(r.by, r.key): r for r in report.strata.collect()}
    assert set(rows) == {("category", 'a, "b"'), ("category", "未分类"), ("difficulty", "易"), ("flag", "retrieval_miss"), ("flag", "retrieval_partial"), ("flag", "retrieval_low_rank")}
    r = rows["category", 'a, "b"']
    assert (r.cases, r.mean_delta, r.improved, r.worsened, r.flagged_left, r.flagged_right) == (3, 0.0, 1, 1, 1, 1)


def lines(df):
    return [r.text for r in df.orderBy("block", "part", "first", "key").collect()]


def test_comparison_as_csv(report):
    out = lines(W.ab_csv(report, 7, 9))
    assert out[:5] == ["对比,run 7,run 9", "共同题目,4,", "噪声底,0.0021,", "可比,是,", "指标,左,右,差值,改善题数,恶化题数,p值,是否显著,是否落在噪声底内"]
    at = out.index("")
    assert out[5:at][0] == "断言支持率,0.5,1,0.5,1,0,1,否,否" and len(out[5:at]) == 7
    assert out[at + 1 : at + 5] == ["翻转题,qid,类别,难度,左侧标签,右侧标签", '修好,q1,"a, ""b""",易,retrieval_miss,干净', '变坏,q2,"a, ""b""",易,干净,retrieval_miss', "标签变化,q3,,易,retrieval_partial,retrieval_low_rank"]
    at = out.index("", at + 1)
    assert out[at + 1] == "分层,分组,题数,Recall 均值差,改善,恶化,左侧有标签,右侧有标签" and out[at + 2 : at + 4] == ['类别,"a, ""b""",3,0,1,1,1,1', "类别,未分类,1,0,0,0,1,1"]
    assert [x.split(",")[1] for x in out if x.startswith("归因标签")] == ["retrieval_partial", "retrieval_miss", "retrieval_low_rank"]


def test_comparison_as_markdown(report):
    out = lines(W.ab_markdown(report, 7, 9))
    assert out[:5] == ["# A/B 对比：run #7（左）vs run #9（右）", "", "共同题目 4 题（左 4 / 右 4）｜差值小于 0.0021 视为落在噪声里", "", "> ⚠️ right"]
    assert "| 幻觉率（越低越好） | 0.5 | 0 | -50.0pp | 1 | 0 | 1 | 不显著（1 题） |" in out
    assert ["## 修好的题（1）", "- q1：检索漏召回(全未命中) → 干净"] == out[out.index("## 修好的题（1）") :][:2]
    assert "## 标签变化但不好不坏（1）" in out and "- 无" not in out
    assert "| 未分类 | 1 | 0.0pp | 0 | 0 | 1 → 1 |" in out


def test_nothing_is_said_of_runs_that_share_too_little(spark):
    left = side(spark, *((f"q{i}", 1.0, []) for i in range(10)))
    for right, reason in ((side(spark, ("q1", 0.0, ["x"]), ("z", 1.0, [])), "too few shared cases"), (side(spark, ("z", 1.0, [])), "no shared cases")):
        r = W.ab_report(left, right)
        head = r.head.first()
        assert (head.comparable, head.reason) == (False, reason)
        assert [df.count() for df in (r.summary, r.moved, r.strata)] == [0, 0, 0]
        assert lines(W.ab_markdown(r, 1, 2)) == ["# A/B 对比：run #1（左）vs run #2（右）", "", f"> ⚠️ 不可比：{reason}"]
        assert f"可比,否({reason})," in lines(W.ab_csv(r, 1, 2))


def test_runs_that_nobody_judged(spark):
    a = side(spark, ("q1", 0.0, []), ("q2", 1.0, []))
    assert W.ab_report(a, a).head.first().generation_note == "nothing judged"
    r = W.ab_report(a, a, generation=False)
    assert r.head.first().generation_note == "" and {x.metric for x in r.summary.collect()} == {"recall", "reciprocal_rank", "hit", "precision"}
    assert "- 无" in lines(W.ab_markdown(r, 1, 2))


def test_lines_are_written_in_order(spark, report, tmp_path):
    W.write_lines(W.ab_csv(report, 1, 2), str(tmp_path / "out"))
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in files).rstrip("\n").split("\n") == lines(W.ab_csv(report, 1, 2))


def test_run_report(spark):
    results = spark.createDataFrame([(1, "q1", 0.5, 1.0, 1.0, ["retrieval_partial"], ["supported", "irrelevant"], 'say "hi",\n ok'), (1, "q2", None, None, None, ["no_gold"], None, None), (1, "q3", 0.0, 0.0, 0.0, ["odd", "no_gold"], [], "x" * 70), (1, "q4", 1.0, 1.0, 1.0, [], ["supported"], " ")], "run_id int, qid string, recall double, reciprocal_rank double, hit double, flags array<string>, claims array<string>, answer string")
    runs = spark.createDataFrame([(1, {"recall_at_k": 0.5, "cases_total": 4.0, "attribution": 1.0, "other": 2.25}), (2, {"recall_at_k": 1.0})], "run_id int, metrics map<string,double>")
    out = W.run_reports(runs, results, 3)
    rows = {r.run_id: r for r in out.collect()}
    assert [c.qid for c in rows[1].worst_cases] == ["q3", "q1", "q4"] and [(f.flag, f.n) for f in rows[1].flag_counts] == [("no_gold", 2), ("odd", 1), ("retrieval_partial", 1)] and rows[2].worst_cases == []
    text = {r.run_id: r.t for r in out.select("run_id", W.run_csv([("run", "run_id")]).alias("t")).collect()}
    assert text[1].split("\n\n") == ["run,1", "指标,值\n题目总数,4\nother,2.25\nRecall@k,0.5", "归因标签,题数\n数据集缺 gold(不可评测),2\nodd,1\n检索部分漏召回,1", "qid,主因,断言(支持/无据/无关),recall,MRR,命中,答案摘要\nq3,odd,—,0,0,0," + "x" * 60 + '…\nq1,检索部分漏召回,1/0/1,0.5,1,1,"say ""hi"", ok"\nq4,—,1/0/0,1,1,1,']
    assert text[2].split("\n\n") == ["run,2", "指标,值\nRecall@k,1", "qid,主因,断言(支持/无据/无关),recall,MRR,命中,答案摘要"]
    md = out.withColumn("x", F.lit("s")).withColumn("corpus", F.lit(None).cast("int")).select(W.run_markdown("run_id", "corpus", "x", "x", "x", "x").alias("t")).first().t
    assert "| Recall@k | 50.0% |" in md and "生成与判定" not in md and "- odd: 1" in md


# Settings whose fingerprints are known.
EMBEDDING = ("siliconflow", "https://api.siliconflow.cn/v1", "BAAI/bge-m3", 1024, 16)
GENERATION = ("siliconflow", "https://api.siliconflow.cn/v1", "deepseek-ai/DeepSeek-V3.2", "qa_zh_v1", 0.0, 512, 3000)
JUDGING = ("siliconflow", "https://api.siliconflow.cn/v1", "deepseek-ai/DeepSeek-V3.2", "judge_claims_zh_v1", "judge_rubric_zh_v2", 0.0, 1024, 3000, True, 12)
REQUEST = """name string, corpus_id long, dataset_id long, chunking struct<strategy:string,chunk_size:int,overlap:int,min_chars:int>, embedding struct<provider:string,base_url:string,model:string,dim:int,batch_size:int>, top_k int,
 generation struct<provider:string,base_url:string,model:string,prompt_id:string,temperature:double,max_tokens:int,max_context_chars:int>,
 judge struct<provider:string,base_url:string,model:string,claims_prompt_id:string,rubric_prompt_id:string,temperature:double,max_tokens:int,max_context_chars:int,enable_rubric:boolean,max_claims:int>"""


def test_known_fingerprints(spark):
    warm, v1 = (*GENERATION[:4], 0.3, *GENERATION[5:]), (*JUDGING[:4], "judge_rubric_zh_v1", *JUDGING[5:])
    asked = {"plain": (None, None, "b6598ed9"), "generation": (GENERATION, None, "e45129b6"), "warm": (warm, None, "ce02ebea"), "both": (GENERATION, JUDGING, "b6175604")}
    rows = [(n, 4, 3, None, EMBEDDING, None, g, j) for n, (g, j, _) in asked.items()]
    out = {r.name: r for r in W.previews(spark.createDataFrame(rows, REQUEST)).collect()}
    assert {n: r.config_hash[:8] for n, r in out.items()} == {n: h for n, (_, _, h) in asked.items()}
    assert {(r.chunking_hash[:8], r.collection, r.error) for r in out.values()} == {("5f45e034", "corpus4_5f45e034", None)}
    # a judge without generation has a fingerprint, but isn't run
    alone = W.previews(spark.createDataFrame([("j", 4, 3, None, EMBEDDING, None, None, JUDGING), ("v1", 4, 3, None, EMBEDDING, None, None, v1)], REQUEST))
    assert {r.error for r in alone.collect()} == {"judge_needs_generation"}


@pytest.mark.parametrize(("change", "error"), [
    ({}, None),
    ({"corpus_id": 0}, "no corpus or dataset"),
    ({"dataset_id": None}, "no corpus or dataset"),
    ({"chunking": ("words", None, None, None)}, "strategy"),
    ({"chunking": (" ", 10, 10, None)}, "overlap"),
    ({"chunking": (None, 0, 0, None)}, "chunk_size"),
    ({"chunking": (None, None, None, -1)}, "min_chars"),
    ({"top_k": 51}, "top_k"),
    ({"top_k": -3}, None),
    ({"generation": (*GENERATION[:3], " ", *GENERATION[4:])}, "generation.prompt_id"),
    ({"generation": (*GENERATION[:4], 2.5, *GENERATION[5:])}, "generation.temperature"),
    ({"generation": (*GENERATION[:5], 0, 1)}, "generation.max_tokens"),
    ({"generation": (*GENERATION[:2], None, *GENERATION[3:])}, "generation.model"),
    ({"judge": (*JUDGING[:9], 0)}, "judge.max_claims"),
    ({"judge": (*JUDGING[:4], "", *JUDGING[5:])}, "judge.rubric_prompt_id"),
    ({"judge": (*JUDGING[:4], "", *JUDGING[5:8], False, 12)}, None),
    ({"judge": JUDGING, "generation": None}, "judge_needs_generation"),
])
def test_what_is_wrong_with_settings(spark, change, error):
    request = {"name": "x", "corpus_id": 1, "dataset_id": 1, "chunking": ("headings", 500, 50, 80), "embedding": EMBEDDING, "top_k": 5, "generation": GENERATION, "judge": None} | change
    row = W.previews(spark.createDataFrame([tuple(request.values())], REQUEST)).first()
    assert row.error == error and (row.config_hash is None) == (error is not None)


def test_contexts_say_what_is_missing(spark):
    hits = "array<struct<point_id:string,score:double>>"
    results = spark.createDataFrame([(1, "q1", [("b", 0.9), ("a", 0.8), ("b", 0.7)]), (1, "q2", [("gone", 0.5)]), (1, "q3", []), (2, "q1", [("a", 0.5)]), (3, "q1", [("a", 0.5)])], f"run_id int, qid string, retrieved {hits}")
    runs = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, None)], "run_id int, collection string")
    points = spark.createDataFrame([("c1", "a", "text a", "s"), ("c1", "b", "text b", "s")], "collection string, point_id string, text string, section string")
    out = {(r.run_id, r.qid): r for r in W.case_contexts(results, runs, points).collect()}
    assert [(c.point_id, c.score, c.text) for c in out[1, "q1"].chunks] == [("b", 0.9, "text b"), ("a", 0.8, "text a")] and out[1, "q1"].error is None
    assert [(c.found, c.text) for c in out[1, "q2"].chunks] == [(False, None)] and out[1, "q2"].error == "chunks missing"
    assert out[1, "q3"].chunks == [] and out[1, "q3"].error is None
    assert out[2, "q1"].error == "no such collection" and out[3, "q1"].error == "no collection in the settings"


def test_calibration_with_everything(spark):
    gold = spark.createDataFrame([(i, "ann", "hallucinated" if i % 3 == 0 else "faithful", False, i % 2 == 0, 3, 4, 3, 9 if i == 0 else 5) for i in range(30)] + [(i, "bo", "faithful", False, None, None, 4, None, None) for i in range(5)], "case_id long, annotator string, verdict string, reviewed boolean, judge_bad boolean, relevance int, helpfulness int, judge_relevance int, judge_helpfulness int")
    row = W.calibration(gold, 60).first()
    assert row.primary_annotator == "ann" and (row.relevance.pairs, row.relevance.mae) == (30, 0.0) and (row.helpfulness.pairs, row.helpfulness.bias) == (29, 1.0)
    assert [d.kind for d in row.disagreements][:5] == ["missed"] * 5 and [d.case_id for d in row.disagreements if d.kind == "missed"] == [3, 9, 15, 21, 27]
    assert row.inter_annotator.binary_pairs == 5
    alone = W.calibration(gold.where("annotator = 'bo'"), 60).first()
    assert alone.relevance is None and alone.inter_annotator is None and alone.disagreements == []


def test_both_ab_reports_come_from_one_search(spark, monkeypatch):
    from evalloom.plans import catalog, whole

    calls, searched = [], catalog.searched
    monkeypatch.setattr(catalog, "searched", lambda *a: calls.append(a) or searched(*a))
    whole.ab_whole_report(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
