"""Queries over whole reports and exports, previews, contexts and report texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import formats
from evalloom.functions import scoring as S
from evalloom.operators import whole_reports as W
from evalloom.plans import catalog, comparisons, oracle
from evalloom.sources.scratch import written
from evalloom.sources.tables import table

Q, SQL = {}, {}


def query(name: str, sql: str):
    def add(make):
        Q[name], SQL[name] = make, sql
        return make

    return add


def num(x: str) -> str:
    return f"regexp_replace(printf('%.6f', ({x})::double), '\\.?0+$', '')"


def cell(x: str) -> str:
    return f"case when regexp_matches({x}, '[\",\\n\\r]') then '\"' || replace({x}, '\"', '\"\"') || '\"' else coalesce({x}, '') end"


def labels(x: str, of: dict[str, str]) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in of.items()) + f" else {x} end"


def with_strata(s: SparkSession, d: str, df: DataFrame) -> DataFrame:
    c = catalog.cases(s, d).select("qid", F.when(F.col("category") % 4 != 0, F.concat(F.lit("c, "), F.col("category").cast("string"))).alias("category"), F.col("difficulty").cast("string").alias("difficulty"))
    return df.join(c, "qid")


def compared_rows(s: SparkSession, d: str) -> DataFrame:
    left, right = comparisons.stored_runs(s, d)
    return written(with_strata(s, d, left).withColumn("run_id", F.lit(1)).unionByName(with_strata(s, d, right).withColumn("run_id", F.lit(2))), "runs")


def compared(s: SparkSession, d: str, least: int = 0, rows: DataFrame | None = None) -> W.ABReport:
    """The report on both runs' cases, which are searched for unless they are given."""
    rows = compared_rows(s, d) if rows is None else rows
    return W.ab_report(rows.where("run_id = 1").drop("run_id"), rows.where(f"run_id = 2 and qid >= {least}").drop("run_id"), True, least == 0)


AB = comparisons.BOTH + ", info as (select qid, case when category % 4 <> 0 then 'c, ' || category end category, difficulty::varchar difficulty from cases)" + comparisons.METRIC_ROWS + comparisons.P_SQL + f""", shown as (select *, abs(delta) <= 2.1e-3 below_noise, not ({comparisons.LOWER}) higher_is_better, p_value < 0.05 and abs(delta) > 2.1e-3 significant from t),
 heads as (select (select count(*) from l) left_cases, (select count(*) from r) right_cases, count(*) shared_cases, count(*) filter (l.claims is not null and r.claims is not null) judged_cases from l join r on l.qid = r.qid),
 moved as (select l.qid, i.category, i.difficulty, {oracle.MOVED.format(l='l.flags', r='r.flags')} transition, l.flags fl, r.flags fr from l join r on l.qid = r.qid join info i on i.qid = l.qid where {oracle.MOVED.format(l='l.flags', r='r.flags')} <> 'stable'),
 cs as (select coalesce(l.recall, 0) lr, coalesce(r.recall, 0) rr, len(l.flags) > 0 lf, len(r.flags) > 0 rf, l.flags fl, r.flags fr, coalesce(i.category, '未分类') category, coalesce(i.difficulty, '未分类') difficulty from l join r on l.qid = r.qid join info i on i.qid = l.qid),
 strata as (""" + " union all ".join(f"select '{b}' \"by\", {b} \"key\", count(*) cases, round(avg(rr - lr), 6) mean_delta, count(*) filter (rr - lr > 2.1e-3) improved, count(*) filter (rr - lr < -2.1e-3) worsened, count(*) filter (lf) fl, count(*) filter (rf) fr from cs group by 2" for b in ("category", "difficulty")) + """
 union all select 'flag', flag, count(*), round(avg(rr - lr), 6), count(*) filter (rr - lr > 2.1e-3), count(*) filter (rr - lr < -2.1e-3), count(*) filter (list_contains(fl, flag)), count(*) filter (list_contains(fr, flag)) from (select *, unnest(list_distinct(list_concat(fl, fr))) flag from cs) group by 2)"""


@query("ab_whole_report", AB + """, few as (select count(*) n from l join r on l.qid = r.qid where r.qid >= (select max(qid) from cases) - 100)
 select 'whole' kind, '' reason, true comparable, '' attribution_missing, shared_cases, judged_cases, (select count(*) from t) metrics, (select count(*) from moved) moved, (select count(*) from strata) strata from heads
 union all select 'few', case when n = 0 then 'no shared cases' else 'too few shared cases' end, false, 'right', n, (select count(*) from l join r on l.qid = r.qid where r.qid >= (select max(qid) from cases) - 100 and l.claims is not null and r.claims is not null), 0, 0, 0 from few""")
def ab_whole_report(s: SparkSession, d: str) -> DataFrame:
    """Two runs that can be compared, and two that share too few cases, of which nothing is said."""
    last = catalog.cases(s, d).agg(F.max("qid").alias("m")).first()["m"]
    out, rows = [], compared_rows(s, d)
    for kind, least in (("whole", 0), ("few", last - 100)):
        r = compared(s, d, least, rows)
        count = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
        row = r.head.crossJoin(count(r.summary, "metrics")).crossJoin(count(r.moved, "moved")).crossJoin(count(r.strata, "strata"))
        out.append(row.select(F.lit(kind).alias("kind"), "reason", "comparable", "attribution_missing", "shared_cases", "judged_cases", "metrics", "moved", "strata"))
    return out[0].unionByName(out[1])


def flags_text(x: str, named: bool) -> str:
    inner = f"list_transform({x}, lambda f: {labels('f', W.FLAG_LABELS)})" if named else x
    return f"case when len({x}) > 0 then array_to_string({inner}, ' + ') else '干净' end"


STRATA_SQL = "case when \"by\" = 'flag' then (fr - fl)::double else mean_delta end"
CSV_SQL = AB + f""", x as (select 1 block, 0 part, 0.0::double "first", '' "key", '对比,run 1,run 2' "text" union all select 1, 1, 0, '', '共同题目,' || shared_cases || ',' from heads union all select 1, 2, 0, '', '噪声底,0.0021,' union all select 1, 3, 0, '', '可比,是,'
 union all select 1, 4, 0, '', '指标,左,右,差值,改善题数,恶化题数,p值,是否显著,是否落在噪声底内' union all select 1, 5, 0, metric, {labels('metric', W.PAIRED_LABELS)} || ',' || {num('mean_left')} || ',' || {num('mean_right')} || ',' || {num('delta')} || ',' || improved || ',' || worsened || ',' || {num('p_value')} || ',' || case when significant then '是' else '否' end || ',' || case when below_noise then '是' else '否' end from shown
 union all select 2, -1, 0, '', '' union all select 2, 0, 0, '', '翻转题,qid,类别,难度,左侧标签,右侧标签' union all select 2, list_position(['fixed', 'broke', 'changed'], transition), 0, qid::varchar, {labels('transition', W.MOVED)} || ',' || qid || ',' || {cell('category')} || ',' || difficulty || ',' || {flags_text('fl', False)} || ',' || {flags_text('fr', False)} from moved
 union all select 3, -1, 0, '', '' union all select 3, 0, 0, '', '分层,分组,题数,Recall 均值差,改善,恶化,左侧有标签,右侧有标签' union all select 3, list_position(['category', 'difficulty', 'flag'], "by"), {STRATA_SQL}, "key", {labels('"by"', W.STRATA)} || ',' || {cell('"key"')} || ',' || cases || ',' || {num('mean_delta')} || ',' || improved || ',' || worsened || ',' || fl || ',' || fr from strata) select * from x"""


@query("compare_csv", CSV_SQL)
def compare_csv(s: SparkSession, d: str) -> DataFrame:
    return W.ab_csv(compared(s, d).written(), 1, 2)


POINTS = "case when {x} > 0 then '+' else '' end || printf('%.1fpp', {x} * 100)"
MD_SQL = AB + f""", n as (select count(*) filter (transition = 'fixed') fixed, count(*) filter (transition = 'broke') broke, count(*) filter (transition = 'changed') changed from moved), x as (select 1 block, 0 part, 0.0::double "first", '' "key", '# A/B 对比：run #1（左）vs run #2（右）' "text" union all select 1, 1, 0, '', ''
 union all select 1, 2, 0, '', '共同题目 ' || shared_cases || ' 题（左 ' || left_cases || ' / 右 ' || right_cases || '）｜差值小于 0.0021 视为落在噪声里' from heads union all select 2, 0, 0, '', '' union all select 2, 1, 0, '', '## 指标' union all select 2, 2, 0, '', '' union all select 2, 3, 0, '', '| 指标 | 左 | 右 | 差值 | 改善 | 恶化 | p 值 | 结论 |' union all select 2, 4, 0, '', '|---|---|---|---|---|---|---|---|'
 union all select 2, 9, 0, metric, '| ' || {labels('metric', W.PAIRED_LABELS)} || case when higher_is_better then '' else '（越低越好）' end || ' | ' || {num('mean_left')} || ' | ' || {num('mean_right')} || ' | ' || {POINTS.format(x='delta')} || ' | ' || improved || ' | ' || worsened || ' | ' || {num('p_value')} || ' | ' || case when below_noise then '噪声内' when significant then '显著' else '不显著' end || '（' || cases || ' 题） |' from shown
 union all select 3, 0, 0, '', '' union all select 3, 1, 0, '', '## 修好的题（' || fixed || '）' from n union all select 3, 2, 0, '', '- 无' from n where fixed = 0 union all select 4, 0, 0, '', '' union all select 4, 1, 0, '', '## 变坏的题（' || broke || '）' from n union all select 4, 2, 0, '', '- 无' from n where broke = 0
 union all select 5, 0, 0, '', '' from n where changed > 0 union all select 5, 1, 0, '', '## 标签变化但不好不坏（' || changed || '）' from n where changed > 0
 union all select (2 + list_position(['fixed', 'broke', 'changed'], transition))::int, 3, 0, qid::varchar, '- ' || qid || '：' || {flags_text('fl', True)} || ' → ' || {flags_text('fr', True)} from moved
 union all select b, i::int, 0, '', case i when 1 then '## ' || title when 3 then '| 分组 | 题数 | Recall 均值差 | 改善 | 恶化 | 有标签(左→右) |' when 4 then '|---|---|---|---|---|---|' else '' end from (values (6, 'category', '按类别'), (7, 'difficulty', '按难度'), (8, 'flag', '按归因标签')) h(b, k, title), range(5) g(i) where k in (select "by" from strata)
 union all select (5 + list_position(['category', 'difficulty', 'flag'], "by"))::int, 9, {STRATA_SQL}, "key", '| ' || "key" || ' | ' || cases || ' | ' || {POINTS.format(x='mean_delta')} || ' | ' || improved || ' | ' || worsened || ' | ' || case when fl = 0 and fr = 0 then '—' else fl || ' → ' || fr end || ' |' from strata) select * from x"""


@query("compare_markdown", MD_SQL)
def compare_markdown(s: SparkSession, d: str) -> DataFrame:
    return W.ab_markdown(compared(s, d).written(), 1, 2)


# Two runs' reports; the answers are the documents with the cases' ids.
def run_rows(s: SparkSession, d: str) -> DataFrame:
    parts = []
    for n, (df, k) in enumerate(zip(comparisons.stored_runs(s, d), (1, 5), strict=True), 1):
        parts.append(df.withColumn("run_id", F.lit(n)).withColumn("k", F.lit(k)))
    rows = parts[0].unionByName(parts[1])
    claims = F.when(F.col("judge").isNotNull(), F.flatten(F.array(*(F.array_repeat(F.lit(c), F.col(f"judge.{c}").cast("int")) for c in ("supported", "unsupported", "irrelevant")))))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("answer"))
    return written(rows.withColumn("claims", claims).join(docs, "qid", "left"), "results")


def run_report_rows(s: SparkSession, d: str) -> DataFrame:
    rows = run_rows(s, d)
    totals = rows.groupBy("run_id").agg(
        S.rounded(F.avg("recall")).alias("recall_at_k"), S.rounded(F.avg("hit")).alias("hit_at_k"), S.rounded(F.avg("reciprocal_rank")).alias("mrr_at_k"), F.count("*").cast("double").alias("cases_total"), F.count("judge").cast("double").alias("cases_judged"),
        S.rounded(F.sum("judge.unsupported") / F.sum("judge.claims")).alias("hallucination_rate"), F.lit(1.0).alias("attribution"))
    metrics = F.create_map(*[x for c in totals.columns[1:] for x in (F.lit(c), F.col(c))])
    runs = totals.select("run_id", metrics.alias("metrics"), F.lit(3).alias("dataset_id"), F.when(F.col("run_id") == 2, 4).alias("corpus_id"), F.lit("succeeded").alias("status"), F.lit("abc").alias("config_hash"), F.lit('x,"y').alias("git_sha"))
    return W.run_reports(runs, rows.select("run_id", "qid", "recall", "reciprocal_rank", "hit", "flags", "claims", "answer"), 10)


SNIP = "nullif(trim(regexp_replace(coalesce(d.text, ''), '\\s+', ' ', 'g')), '')"
RUN_SQL = comparisons.BOTH + f""", rows as (select 1 run_id, * from l union all select 2, * from r), m as (select run_id, round(avg(recall), 6) recall_at_k, round(avg(hit), 6) hit_at_k, round(avg(reciprocal_rank), 6) mrr_at_k, count(*)::double cases_total, count(claims)::double cases_judged, round(sum(unsupported) / sum(claims), 6) hallucination_rate from rows group by 1),
 worst as (select *, row_number() over (partition by run_id order by recall nulls last, qid) place from rows qualify place <= 10), fc as (select run_id, flag, count(*) n from (select run_id, unnest(flags) flag from rows) group by 1, 2),
 snip as (select w.*, {SNIP} sn from worst w left join documents d on d.doc_id = w.qid)"""


@query("run_report_csv", RUN_SQL + f""", b2 as (select run_id, string_agg({labels('k', W.RUN_LABELS)} || ',' || v, chr(10) order by k) t from (select run_id, k, {num('v')} v from (unpivot m on recall_at_k, hit_at_k, mrr_at_k, cases_total, cases_judged, hallucination_rate into name k value v)) group by 1),
 b3 as (select run_id, string_agg({labels('flag', W.FLAG_LABELS)} || ',' || n, chr(10) order by n desc, flag) t from fc group by 1),
 b4 as (select run_id, string_agg(qid || ',' || case when len(flags) > 0 then {labels('flags[1]', W.FLAG_LABELS)} else '—' end || ',' || case when claims > 0 then supported || '/' || unsupported || '/' || irrelevant else '—' end || ',' || coalesce({num('recall')}, '') || ',' || coalesce({num('reciprocal_rank')}, '') || ',' || coalesce({num('hit')}, '') || ',' || coalesce({cell("case when length(sn) <= 60 then sn else substr(sn, 1, 60) || '…' end")}, ''), chr(10) order by place) t from snip group by 1)
 select run_id, concat_ws(chr(10) || chr(10), 'run,' || run_id || chr(10) || '评测集,3' || chr(10) || '状态,succeeded' || chr(10) || 'config_hash,abc' || chr(10) || 'git_sha,"x,""y"', '指标,值' || chr(10) || b2.t, '归因标签,题数' || chr(10) || b3.t, 'qid,主因,断言(支持/无据/无关),recall,MRR,命中,答案摘要' || chr(10) || b4.t) "text" from b2 left join b3 using (run_id) left join b4 using (run_id)""")
def run_report_csv(s: SparkSession, d: str) -> DataFrame:
    head = [("run", "run_id"), ("评测集", "dataset_id"), ("状态", "status"), ("config_hash", "config_hash"), ("git_sha", "git_sha")]
    return run_report_rows(s, d).select("run_id", W.run_csv(head).alias("text"))


PCT = "coalesce(printf('%.1f%%', {x} * 100), '—')"


@query("run_report_markdown", RUN_SQL + f""", fl as (select run_id, string_agg('- ' || {labels('flag', W.FLAG_LABELS)} || ': ' || n, chr(10) order by n desc, flag) t from fc group by 1)
 select run_id, concat_ws(chr(10), '# run #' || run_id || ' 评测报告', '', '- 评测集: dataset 3' || case when run_id = 2 then ' · corpus 4' else '' end, '- 状态: succeeded', '- config_hash: `abc` · git_sha: `x,"y`', '- 生成时间: now', '', '## 指标', '', '| 指标 | 值 |', '| --- | --- |', '| Recall@k | ' || {PCT.format(x='recall_at_k')} || ' |', '| MRR@k | ' || {PCT.format(x='mrr_at_k')} || ' |', '| Hit@k | ' || {PCT.format(x='hit_at_k')} || ' |',
 chr(10) || '## 生成与判定', '', '| 指标 | 值 |', '| --- | --- |', '| 幻觉率 | ' || {PCT.format(x='hallucination_rate')} || ' |', '| 断言支持率 | — |', '| 无关断言率 | — |', '| 判定题数 | ' || {num('cases_judged')} || ' |', chr(10) || '## 归因标签分布' || chr(10) || chr(10) || fl.t, chr(10) || '> 逐题明细（含每题的断言与答案摘要）见同目录的 CSV 导出。') "text" from m left join fl using (run_id)""")
def run_report_markdown(s: SparkSession, d: str) -> DataFrame:
    return run_report_rows(s, d).withColumn("made", F.lit("now")).select("run_id", W.run_markdown("dataset_id", "corpus_id", "status", "config_hash", "git_sha", "made").alias("text"))


@query("run_report_json", RUN_SQL + """ select run_id, (select string_agg(qid || ':' || array_to_string(flags, '+'), ',' order by place) from worst w where w.run_id = m.run_id) worst, (select string_agg(flag || ':' || n, ',' order by n desc, flag) from fc where fc.run_id = m.run_id) flags from m""")
def run_report_json(s: SparkSession, d: str) -> DataFrame:
    """The report as JSON, read again."""
    written_ = run_report_rows(s, d).select("run_id", W.run_json().alias("json"))
    read = written_.select("run_id", F.from_json("json", "worst_cases array<struct<qid:bigint,recall:double,flags:array<string>>>, flag_counts map<string,bigint>").alias("r"))
    worst = F.array_join(F.transform("r.worst_cases", lambda c: F.concat(c["qid"].cast("string"), F.lit(":"), F.array_join(c["flags"], "+"))), ",")
    flags = F.array_join(F.transform(F.map_entries("r.flag_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return read.select("run_id", worst.alias("worst"), flags.alias("flags"))


# People's gold with both scores.
GOLD_SQL = comparisons.HUMAN.replace("case when l.doc_id % 5 <> 0 then 1 + n_chars % 5 end helpfulness", "case when l.doc_id % 5 <> 0 then 1 + n_chars % 5 end helpfulness, 1 + (n_chars + quality) % 5 relevance, case when l.doc_id % 6 <> 0 then 1 + (n_chars // 5) % 6 end judge_helpfulness, 1 + (n_chars // 7) % 5 judge_relevance")


def scored_gold(s: SparkSession, d: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    verdict = F.when(i % 17 == 0, "unclear").when(F.col("toxic") == 1, "hallucinated").otherwise("faithful")
    j = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select(F.expr("doc_id div 2").alias("case_id"), F.when(i % 2 == 0, "ann").otherwise("bo").alias("annotator"), verdict.alias("verdict"), (i % 4 == 0).alias("reviewed"), F.when(i % 13 != 0, n % 4 == 0).alias("judge_bad"), F.when(i % 5 != 0, 1 + n % 5).alias("helpfulness"), (1 + (n + F.col("quality")) % 5).alias("relevance"), F.when(i % 6 != 0, 1 + F.expr("n_chars div 5") % 6).alias("judge_helpfulness"), (1 + F.expr("n_chars div 7") % 5).alias("judge_relevance"))


def score_sql(name: str) -> str:
    return f"""(select count(*) from own where judge_{name} between 1 and 5 and {name} between 1 and 5) {name}_pairs, (select round(avg(abs(judge_{name} - {name})), 4) from own where judge_{name} between 1 and 5 and {name} between 1 and 5) {name}_mae, (select round(round(avg(judge_{name}), 4) - round(avg({name}), 4), 4) from own where judge_{name} between 1 and 5 and {name} between 1 and 5) {name}_bias"""


@query("calibration_whole", "with " + GOLD_SQL + """, own as (select * from gold where annotator = (select annotator from names order by n desc, annotator limit 1)), apart as (select case when verdict = 'hallucinated' then 'missed' else 'false_alarm' end kind, case_id from own where judge_bad is not null and verdict <> 'unclear' and (verdict = 'hallucinated') <> judge_bad order by 1 desc, 2 limit 50)
 select (select max(annotator) from own) primary_annotator, """ + score_sql("relevance") + ", " + score_sql("helpfulness") + """, (select string_agg(kind || ' ' || case_id, ',' order by kind desc, case_id) from apart) disagreements,
 (select count(*) from gold x join gold y on x.case_id = y.case_id and x.annotator = 'ann' and y.annotator = 'bo' where x.verdict <> 'unclear' and y.verdict <> 'unclear') annotator_pairs""")
def calibration_whole(s: SparkSession, d: str) -> DataFrame:
    out = W.calibration(scored_gold(s, d), 10_000)
    listed = F.array_join(F.transform("disagreements", lambda x: F.concat(x["kind"], F.lit(" "), x["case_id"].cast("string"))), ",")
    scores = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("relevance", "helpfulness") for c in ("pairs", "mae", "bias")]
    return out.select("primary_annotator", *scores, listed.alias("disagreements"), F.col("inter_annotator.binary_pairs").alias("annotator_pairs"))


# Settings of a pipeline, from parts.
EMBEDDING = '"embedding":{"base_url":"http://e","batch_size":16,"dim":1024,"model":"bge","provider":"p"}'
PREVIEW_SQL = f"""p as (select p_partkey id, p_partkey % 4 corpus_id, case when p_partkey % 5 = 0 then 'paragraph' when p_partkey % 5 = 1 then '' when p_partkey % 5 = 2 then 'words' end s0, case when p_size % 2 = 0 then p_size * 10 end c0, case when p_size % 3 = 0 then p_size * 4 end o0, p_size - 10 k0, p_partkey % 3 = 0 gen, p_partkey % 9 = 0 or p_partkey % 11 = 0 jud, p_brand from part),
 q as (select *, coalesce(nullif(s0, ''), 'headings') st, coalesce(c0, 500) cs, coalesce(o0, 50) ov, case when k0 <= 0 then 5 else k0 end k from p), h as (select *, '{{"chunk_size":' || cs || ',"min_chars":80,"overlap":' || ov || ',"strategy":"' || st || '"}}' ch from q),
 e as (select *, case when corpus_id = 0 then 'no corpus or dataset' when st not in ('headings', 'fixed', 'paragraph') then 'strategy' when cs <= 0 then 'chunk_size' when ov >= cs then 'overlap' when k > 35 and k > 50 then 'top_k' when jud and not gen then 'judge_needs_generation' end error,
 '{{"chunking":' || ch || ',"data":{{"corpus_id":' || corpus_id || ',"dataset_id":7}},{EMBEDDING},"extras":{{}}' || case when gen then ',"generation":{{"base_url":"u","max_context_chars":3000,"max_tokens":512,"model":"' || p_brand || '","prompt_id":"qa","provider":"g","temperature":0.5}}' else '' end || case when jud then ',"judge":{{"base_url":"u","claims_prompt_id":"c","enable_rubric":true,"max_claims":12,"max_context_chars":3000,"max_tokens":1024,"model":"j","prompt":0}}' else '' end || ',"retrieval":{{"reranker":{{"enabled":false}},"top_k":' || k || '}}}}' snap from h)"""
PREVIEW_SQL = PREVIEW_SQL.replace('"model":"j","prompt":0}', '"model":"j","provider":"g","rubric_prompt_id":"r","temperature":0}')


@query("pipeline_previews", f"with {PREVIEW_SQL} select id, error, case when error is null then sha256(snap) end config_hash, case when error is null then sha256(ch) end chunking_hash, case when error is null then 'corpus' || corpus_id || '_' || substr(sha256(ch), 1, 8) end \"collection\", gen generation_enabled, jud judge_enabled from e")
def pipeline_previews(s: SparkSession, d: str) -> DataFrame:
    i, n = F.col("p_partkey"), F.col("p_size")
    strategy = F.when(i % 5 == 0, "paragraph").when(i % 5 == 1, "").when(i % 5 == 2, "words")
    chunking = F.struct(strategy.alias("strategy"), F.when(n % 2 == 0, n * 10).alias("chunk_size"), F.when(n % 3 == 0, n * 4).alias("overlap"), F.lit(None).cast("int").alias("min_chars"))
    embedding = F.struct(F.lit("p").alias("provider"), F.lit("http://e").alias("base_url"), F.lit("bge").alias("model"), F.lit(1024).alias("dim"), F.lit(16).alias("batch_size"))
    generation = F.when(i % 3 == 0, F.struct(F.lit("g").alias("provider"), F.lit("u").alias("base_url"), F.col("p_brand").alias("model"), F.lit("qa").alias("prompt_id"), F.lit(0.5).alias("temperature"), F.lit(512).alias("max_tokens"), F.lit(3000).alias("max_context_chars")))
    judge = F.when((i % 9 == 0) | (i % 11 == 0), F.struct(F.lit("g").alias("provider"), F.lit("u").alias("base_url"), F.lit("j").alias("model"), F.lit("c").alias("claims_prompt_id"), F.lit("r").alias("rubric_prompt_id"), F.lit(0.0).alias("temperature"), F.lit(1024).alias("max_tokens"), F.lit(3000).alias("max_context_chars"), F.lit(True).alias("enable_rubric"), F.lit(12).alias("max_claims")))
    asked = table(s, d, "part").select(i.alias("id"), (i % 4).alias("corpus_id"), F.lit(7).alias("dataset_id"), chunking.alias("chunking"), embedding.alias("embedding"), (n - 10).alias("top_k"), generation.alias("generation"), judge.alias("judge"))
    return W.previews(asked).select("id", "error", "config_hash", "chunking_hash", "collection", "generation_enabled", "judge_enabled")


@query("case_contexts", "with " + oracle.ranked("r", 32, 5) + """, c as (select qid, case when qid % 40 = 30 then null when qid % 40 = 20 then 'gone' else 'corpus1' end coll, vec_id, rank from r),
 p as (select doc_id vec_id, 'corpus1' coll, length(text) n from documents where doc_id % 7 <> 0) select c.qid, c.coll "collection", string_agg(c.vec_id || ':' || coalesce(p.n::varchar, '-'), ',' order by rank) chunks,
 case when c.coll is null then 'no collection in the settings' when c.coll = 'gone' then 'no such collection' when count(*) > count(p.n) then 'chunks missing' end error from c left join p on p.vec_id = c.vec_id and p.coll = c.coll group by 1, 2""")
def case_contexts(s: SparkSession, d: str) -> DataFrame:
    hits = catalog.retrieved(s, d, 32, 5)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").cast("string").alias("point_id"), "score"))), lambda h: F.struct(h["point_id"], h["score"]))
    # each chunk twice: the second time doesn't count; a run for each ten cases
    results = hits.groupBy("qid").agg(listed.alias("r")).select((F.col("qid") % 40).alias("run_id"), "qid", F.concat("r", "r").alias("retrieved"))
    runs = results.select("run_id").distinct().withColumn("collection", F.when(F.col("run_id") == 20, "gone").when(F.col("run_id") != 30, "corpus1"))
    points = table(s, d, "documents").where("doc_id % 7 <> 0").select(F.lit("corpus1").alias("collection"), F.col("doc_id").cast("string").alias("point_id"), "text", F.lit("").alias("section"))
    shown = F.array_join(F.transform("chunks", lambda c: F.concat(c["point_id"], F.lit(":"), F.coalesce(F.length(c["text"]).cast("string"), F.lit("-")))), ",")
    return W.case_contexts(results, runs, points).select("qid", "collection", shown.alias("chunks"), "error")


@query("report_texts", """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') made, coalesce(nullif(substr(case when o_orderkey % 4 = 0 then '' else sha256(o_orderkey::varchar) end, 1, 8), ''), '—') short_hash, case when o_custkey % 3 > 0 then least(round(o_orderkey % 10 / (o_custkey % 3) * 100, 1), 100.0) else 0.0 end progress,
 case when o_orderkey % 6 = 0 then '这次 run 上还没有可核对的标注' else concat_ws(' ｜ ', '已标 ' || o_orderkey % 6 || ' 题', case when o_orderkey % 5 > 0 then '其中 fixed ' || o_orderkey % 5 || ' 题, ' || o_orderkey % 2 || ' 题确认变好可销单' end, case when o_orderkey % 3 > 0 then '⚠ ' || o_orderkey % 3 || ' 题反而变坏' end, case when o_orderkey % 7 > 0 then o_orderkey % 7 || ' 题换了病因' end, case when o_custkey % 2 > 0 then o_custkey % 2 || ' 题判断不了' end) end closure,
 case when o_orderkey % 9 <> 0 then '归因口径：规则 v1 · k=' || 1 + o_orderkey % 9 || ' · 排序阈值 >' || o_custkey % 5 || ' · 达标线 ≤3 · 覆盖 retrieval' end attribution from orders""")
def report_texts(s: SparkSession, d: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    meta = F.when(o % 9 != 0, F.struct(F.lit(1).alias("version"), (1 + o % 9).alias("k"), (c % 5).alias("low_rank_limit"), F.lit(3).alias("quality_line"), F.lit("retrieval").alias("scope")))
    return table(s, d, "orders").select("o_orderkey", formats.date_time(F.col("o_orderdate")).alias("made"), formats.short_hash(F.when(o % 4 == 0, "").otherwise(F.sha2(o.cast("string"), 256))).alias("short_hash"), formats.progress_percent(o % 10, c % 3).alias("progress"), formats.closure_line(o % 6, o % 5, o % 2, o % 3, o % 7, c % 2).alias("closure"), formats.attribution_text(meta).alias("attribution"))
