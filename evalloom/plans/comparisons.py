"""Queries over whole reports: A/B, closure, consistency, replay, calibration; and over chunks, anchors and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import scoring as S
from evalloom.operators import experiments as X
from evalloom.operators import passages
from evalloom.operators import prompting as P
from evalloom.plans import catalog, oracle
from evalloom.plans.evaluation import NAMESPACE, state_of
from evalloom.sources.scratch import written
from evalloom.sources.tables import table

Q, SQL = {}, {}


def query(name: str, sql: str):
    def add(make):
        Q[name], SQL[name] = make, sql
        return make

    return add


# Two evaluated runs whose judgements look at the lengths of whole conversations.
def stored_runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The cases of both runs, searched for and judged once and written; the second one's judge sees other lengths and not all conversations."""
    n = (F.length("text") + F.col("run_id") - 1).cast("long")
    label = F.col("n") % 3
    turns = table(s, d, "conversations").select("conv_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("run_id")).where("run_id = 1 or conv_id % 4 <> 0")
    j = turns.select("run_id", (F.col("conv_id") * 10).alias("qid"), n.alias("n")).groupBy("run_id", "qid").agg(
        F.count("*").alias("claims"), F.count_if(label == 0).alias("supported"), F.count_if(label == 1).alias("unsupported"), F.count_if(label == 2).alias("irrelevant"), (1 + F.sum("n") % 5).alias("relevance"), (1 + F.max("n") % 5).alias("helpfulness"))
    judge = F.struct("claims", "supported", "unsupported", "irrelevant", "relevance", "helpfulness")
    m = catalog.run_metrics(s, d, catalog.searched(s, d, 48), {1: (48, 1), 2: (48, 5)}).where("run_id = 1 or qid % 130 <> 0")
    m = m.join(j.select("run_id", "qid", judge.alias("judge")), ["run_id", "qid"], "left")
    flags = S.flags(F.struct("gold_count", "hits", "first_hit_rank"), F.col("judge"), F.col("k"))
    rows = written(m.select("run_id", "qid", "gold_count", "hits", "recall", "precision", "reciprocal_rank", "hit", "first_hit_rank", "judge", flags.alias("flags")), "runs")
    return rows.where("run_id = 1").drop("run_id"), rows.where("run_id = 2").drop("run_id")


def judged_sql(name: str, shift: int, where: str) -> str:
    return f"""{name} as (select qid, count(*) claims, count(*) filter (n % 3 = 0) supported, count(*) filter (n % 3 = 1) unsupported, count(*) filter (n % 3 = 2) irrelevant, 1 + sum(n)::bigint % 5 relevance, 1 + max(n) % 5 helpfulness
 from (select conv_id * 10 qid, length(text) + {shift} n from conversations where {where}) group by 1)"""


def side_sql(name: str, source: str, judge: str, k: int, where: str) -> str:
    return oracle.flagged(f"{name}_f", source, k, True).replace("left join judged j", f"left join {judge} j") + f", {name} as (select m.*, j.claims, j.supported, j.unsupported, j.irrelevant, j.relevance, j.helpfulness from {name}_f m left join {judge} j on m.qid = j.qid where {where})"


BOTH = "with recursive " + oracle.GOLD + ", " + oracle.run("a", 48, 1) + ", " + oracle.run("b", 48, 5) + ", " + judged_sql("ja", 0, "true") + ", " + judged_sql("jb", 1, "conv_id % 4 <> 0") + ", " + side_sql("l", "a", "ja", 1, "true") + ", " + side_sql("r", "b", "jb", 5, "m.qid % 130 <> 0")
VALUES = {"recall": "coalesce({}.recall, 0)", "reciprocal_rank": "coalesce({}.reciprocal_rank, 0)", "hit": "coalesce({}.hit, 0)", "precision": "coalesce({}.\"precision\", 0)", "claim_support_rate": "{0}.supported / nullif({0}.claims, 0)", "hallucination_rate": "{0}.unsupported / nullif({0}.claims, 0)", "irrelevant_rate": "{0}.irrelevant / nullif({0}.claims, 0)", "helpfulness": "{}.helpfulness::double", "relevance": "{}.relevance::double"}
LOWER = "metric in ('hallucination_rate', 'irrelevant_rate')"
METRIC_ROWS = ", v as (select * from (" + " union all ".join(f"select l.qid, '{m}' metric, {e.format('l')} l, {e.format('r')} r from l join r on l.qid = r.qid" for m, e in VALUES.items()) + ") where l is not null and r is not null)"
# p by counting all rank sums up to 25 differences, beyond by the normal distribution, whose error function is a series of positive terms
P_SQL = """, nz as (select metric, r - l d from v where r <> l), rk as (select metric, d, (2 * rank() over (partition by metric order by abs(d)) + count(*) over (partition by metric, abs(d)) - 1)::bigint r2 from nz),
 g as (select metric, count(*) n, list(r2) ranks, coalesce(sum(r2) filter (d > 0), 0)::bigint w2 from rk group by 1), tied as (select metric, sum(t * t * t - t) ties from (select metric, abs(d) a, count(*) t from nz group by 1, 2) group by 1),
 dp as (select metric, 0 i, list_transform(range(n * (n + 1) + 1), lambda x: case when x = 0 then 1.0::double else 0.0::double end) c, ranks, n, w2 from g where n <= 25
 union all select metric, i + 1, list_transform(range(len(c)), lambda x: c[x + 1] + case when x >= ranks[i + 1] then c[x - ranks[i + 1] + 1] else 0.0 end), ranks, n, w2 from dp where i < n),
 exact as (select metric, round(least(1.0, list_sum(list_filter(c, lambda x, j: abs((j - 1) - n * (n + 1) // 2) >= abs(w2 - n * (n + 1) // 2))) / pow(2, n)), 6) p from dp where i = n),
 z as (select metric, round((w2 / 2.0 - n * (n + 1) / 4.0 + case when w2 / 2.0 > n * (n + 1) / 4.0 then -0.5 else 0.5 end) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 6) z from g join tied using (metric) where n > 25),
 large as (select metric, round(1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(150), lambda i: exp(i * ln(4) + lgamma(i + 1) - lgamma(2 * i + 2) + (2 * i + 1) * ln(abs(z) / sqrt(2))))), 6) p from z),
 p as (select * from exact union all select * from large),
 s as (select metric, count(*) cases, round(avg(l), 6) mean_left, round(avg(r), 6) mean_right, count(*) filter (case when """ + LOWER + " then l - r else r - l end > 2.1e-3) improved, count(*) filter (case when " + LOWER + """ then l - r else r - l end < -2.1e-3) worsened,
 count(*) filter (abs(r - l) <= 2.1e-3) unchanged from v group by 1), t as (select s.*, coalesce(p, 1.0) p_value, round(mean_right - mean_left, 6) delta from s left join p using (metric))"""


def pairs(s: SparkSession, d: str) -> DataFrame:
    return X.paired_cases(*stored_runs(s, d))


@query("ab_report", BOTH + METRIC_ROWS + P_SQL + f" select *, abs(delta) <= 2.1e-3 below_noise, not ({LOWER}) higher_is_better, p_value < 0.05 and abs(delta) > 2.1e-3 significant from t")
def ab_report(s: SparkSession, d: str) -> DataFrame:
    return X.ab_summary(X.metric_pairs(pairs(s, d)))


@query("ab_comparable", BOTH + " select (select count(*) from l) left_cases, (select count(*) from r) right_cases, count(*) shared_cases, count(*) filter (l.claims is not null and r.claims is not null) judged_cases, '' reason, true comparable from l join r on l.qid = r.qid")
def ab_comparable(s: SparkSession, d: str) -> DataFrame:
    left, right = stored_runs(s, d)
    return X.comparability(left, right, X.paired_cases(left, right))


@query("ab_changed_cases", BOTH + f" select * from (select l.qid, {oracle.MOVED.format(l='l.flags', r='r.flags')} transition from l join r on l.qid = r.qid) where transition <> 'stable'")
def ab_changed_cases(s: SparkSession, d: str) -> DataFrame:
    return X.transitions_of(pairs(s, d))


@query("ab_flag_strata", BOTH + """, e as (select l.flags lf, r.flags rf, coalesce(r.recall, 0) - coalesce(l.recall, 0) d, unnest(list_distinct(list_concat(l.flags, r.flags))) flag from l join r on l.qid = r.qid)
 select flag, count(*) cases, count(*) filter (list_contains(lf, flag)) flagged_left, count(*) filter (list_contains(rf, flag)) flagged_right, round(avg(d), 6) mean_delta, count(*) filter (d > 2.1e-3) improved, count(*) filter (d < -2.1e-3) worsened from e group by 1""")
def ab_flag_strata(s: SparkSession, d: str) -> DataFrame:
    return X.flag_strata(pairs(s, d))


@query("run_guards", """select o_orderkey, case when o_custkey % 11 = 0 then 'no run' when o_custkey % 7 = o_orderkey % 7 then 'one run' when o_custkey % 2 <> 0 then 'other dataset' else '' end error,
 case when o_orderkey % 3 = 0 and o_orderkey % 4 <> 0 then 'right' when o_orderkey % 3 <> 0 and o_orderkey % 4 = 0 then 'left' else '' end attribution_missing from orders""")
def run_guards(s: SparkSession, d: str) -> DataFrame:
    run = lambda i, data, done: F.struct(i.alias("id"), data.alias("dataset_id"), done.alias("attribution"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(s, d, "orders").select("o_orderkey", run(F.when(c % 11 == 0, 0).otherwise(1 + c % 7), F.lit(0), F.when(o % 3 == 0, True)).alias("left"), run(1 + o % 7, c % 2, o % 4 == 0).alias("right"))
    return X.run_guard(rows).select("o_orderkey", "error", "attribution_missing")


STATUS = f"{oracle.STATES}[(qid // 10) % 4 + 1]"
CLOSED = BOTH + f""", ann as (select qid, {STATUS} status from cases), c0 as (select a.qid, a.status, l.flags lf, r.flags rf, case when r.flags is null then 'unverifiable' else replace(replace({oracle.MOVED.format(l='l.flags', r='r.flags')}, 'fixed', 'improved'), 'broke', 'worsened') end verdict
 from ann a join l on a.qid = l.qid left join r on a.qid = r.qid), records as (select qid, status, verdict, case when rf is null then 'missing' when verdict in ('worsened', 'changed') then verdict when verdict = 'stable' then case when len(rf) > 0 then 'same flags' else 'clean before' end
 when status = 'fixed' then '' else 'still ' || status end blocked, verdict = 'improved' and status = 'fixed' eligible, (list_position(['improved', 'worsened', 'changed', 'stable', 'unverifiable'], verdict) - 1)::bigint place from c0)"""


def annotated(s: SparkSession, d: str) -> DataFrame:
    c = catalog.cases(s, d).select("qid", F.expr("qid div 10").alias("n"))
    return c.select("qid", state_of("n", tuple(S.TRANSITIONS)).alias("status"))


@query("closure_report", CLOSED + " select * from records")
def closure_report(s: SparkSession, d: str) -> DataFrame:
    return X.closure_records(annotated(s, d), *stored_runs(s, d))


@query("closure_totals", CLOSED + " select count(*) annotated, " + ", ".join(f"count(*) filter (verdict = '{v}') {v}" for v in X.VERDICT_ORDER) + ", " + ", ".join(f"count(*) filter (status = '{v}') status_{v}" for v in S.TRANSITIONS) + ", count(*) filter (eligible) eligible_for_verify from records")
def closure_totals(s: SparkSession, d: str) -> DataFrame:
    return X.closure_summary(X.closure_records(annotated(s, d), *stored_runs(s, d)))


# here a metric that a side lacks isn't 0
KNOWN = {m: e if m in X.GENERATION else "{}." + f'"{m}"' for m, e in VALUES.items()}
EVIDENCE = ", e0 as (" + " union all ".join(f"select l.qid, '{m}' metric, {e.format('l')} l, {e.format('r')} r from l join r on l.qid = r.qid" for m, e in KNOWN.items()) + f"""),
 e as (select qid, metric, l is not null and r is not null comparable, case when l is not null and r is not null then round(l, 4) end left_value, case when l is not null and r is not null then round(r, 4) end right_value, round(r - l, 4) delta,
 case when l is null or r is null or abs(r - l) <= 2.1e-3 then 'same' when (r > l) = (not ({LOWER})) then 'better' else 'worse' end direction from e0)"""


@query("closure_evidence", BOTH + EVIDENCE + " select * from e")
def closure_evidence(s: SparkSession, d: str) -> DataFrame:
    return X.closure_evidence(pairs(s, d))


@query("closure_highlights", BOTH + EVIDENCE + """ select *, row_number() over (partition by qid order by case when not comparable then 3 when direction = 'worse' then 0 when direction = 'better' then 1 else 2 end, coalesce(abs(delta), 0) desc, metric) place from e qualify place <= 3""")
def closure_highlights(s: SparkSession, d: str) -> DataFrame:
    return X.evidence_highlights(X.closure_evidence(pairs(s, d)))


# Two runs of the same settings, with what retrieval of other dimensions changes.
CONSISTENT = "with " + oracle.GOLD + ", " + oracle.run("a", 60, 5) + ", " + oracle.run("b", 64, 5) + ", " + oracle.flagged("fa", "a", 5) + ", " + oracle.flagged("fb", "b", 5) + """, l as (select fa.*, i.ids from fa join (select qid, list(vec_id order by rank) ids from a_r group by 1) i on fa.qid = i.qid where fa.qid % 110 <> 0),
 r as (select fb.*, i.ids from fb join (select qid, list(vec_id order by rank) ids from b_r group by 1) i on fb.qid = i.qid where fb.qid % 130 <> 0), x as (select l.qid, list_filter([case when l.recall is distinct from r.recall and not coalesce(abs(l.recall - r.recall) <= 1e-9, false) then 'recall' end,
 case when l.hits is distinct from r.hits then 'hits' end, case when l.first_hit_rank is distinct from r.first_hit_rank then 'first_hit_rank' end], lambda x: x is not null) metrics, l.flags <> r.flags flags_differ, l.ids <> r.ids order_differs from l join r on l.qid = r.qid)"""
KEYS = ["recall", "hits", "first_hit_rank"]


def consistent_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = catalog.searched(s, d, 60)

    ids = found.groupBy("dims", "qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    m = catalog.run_metrics(s, d, found, {60: (60, 5), 64: (64, 5)})
    flags = S.flags(F.struct("gold_count", "hits", "first_hit_rank"), F.lit(None).cast(catalog.NOT_JUDGED), F.col("k"))
    rows = m.withColumn("flags", flags).join(ids.withColumnRenamed("dims", "run_id"), ["run_id", "qid"]).select("run_id", "qid", *KEYS, "flags", "ids")
    rows = written(rows.where("(run_id = 60 and qid % 110 <> 0) or (run_id = 64 and qid % 130 <> 0)"), "runs")
    return rows.where("run_id = 60").drop("run_id"), rows.where("run_id = 64").drop("run_id")


@query("case_differences", CONSISTENT + " select qid, array_to_string(metrics, ',') metrics, flags_differ, order_differs from x")
def case_differences(s: SparkSession, d: str) -> DataFrame:
    out = X.metric_differences(*consistent_sides(s, d), KEYS)
    return out.withColumn("metrics", F.array_join("metrics", ","))


@query("consistency_report", CONSISTENT + """ select count(*) filter (len(metrics) > 0 or flags_differ) case_diffs, count(*) filter (order_differs) order_diffs, (select count(*) from l where qid not in (select qid from r)) only_in_left, (select count(*) from r where qid not in (select qid from l)) only_in_right, '' reason,
 1::bigint exit_code from x""")
def consistency_report(s: SparkSession, d: str) -> DataFrame:
    run = F.struct(F.lit("h").alias("config_hash"), F.lit(1).alias("dataset_id"), F.lit(2).alias("corpus_id"), F.lit("succeeded").alias("status"))
    return X.consistency_verdict(*consistent_sides(s, d), F.struct(run.alias("left"), run.alias("right")), KEYS)


@query("attribution_replay", BOTH + " select l.qid, array_to_string(l.flags, ',') old_flags, array_to_string(r.flags, ',') new_flags, list_sort(l.flags) <> list_sort(r.flags) changed from l join r on l.qid = r.qid")
def attribution_replay(s: SparkSession, d: str) -> DataFrame:
    out = X.replay(*stored_runs(s, d))
    return out.withColumn("old_flags", F.array_join("old_flags", ",")).withColumn("new_flags", F.array_join("new_flags", ","))


@query("attribution_settings", "with k as (select case when max(p_size % 3) > 7 then 0 else 50 end k, count(*) n from part) select 1 \"version\", 'retrieval+judge' scope, 5 k, 3 low_rank_limit, 0.5 low_rank_ratio, 3 quality_line, k resolved from k")
def attribution_settings(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "part").agg(X.resolved_k(F.lit(None).cast("int"), F.col("p_size")).alias("resolved"))
    return k.select(X.attribution_meta(5, True).alias("m"), "resolved").select("m.*", "resolved")


@query("suggestions", BOTH + f" select qid, case when claims is null and reason = 'hallucination' then 'unknown' else reason end reason from (select qid, claims, {oracle.REASON} reason from (select qid, case when qid % 30 = 0 then ['hallucination'] else flags end flags, claims from r))")
def suggestions(s: SparkSession, d: str) -> DataFrame:
    _, right = stored_runs(s, d)
    r = right.withColumn("flags", F.when(F.col("qid") % 30 == 0, F.array(F.lit("hallucination"))).otherwise(F.col("flags")))
    return r.select("qid", X.suggestion(F.col("flags"), F.col("judge").isNotNull(), S.reason(F.col("flags"))).alias("reason"))


# People's gold.
HUMAN = """gold as (select l.doc_id // 2 case_id, case when l.doc_id % 2 = 0 then 'ann' else 'bo' end annotator, case when l.doc_id % 17 = 0 then 'unclear' when toxic = 1 then 'hallucinated' else 'faithful' end verdict, l.doc_id % 4 = 0 reviewed,
 case when l.doc_id % 13 <> 0 then n_chars % 4 = 0 end judge_bad, case when l.doc_id % 5 <> 0 then 1 + n_chars % 5 end helpfulness from labels l join documents d on l.doc_id = d.doc_id), names as (select annotator, count(*) n from gold group by 1)"""


def human_gold(s: SparkSession, d: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    verdict = F.when(i % 17 == 0, "unclear").when(F.col("toxic") == 1, "hallucinated").otherwise("faithful")
    j = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select(F.expr("doc_id div 2").alias("case_id"), F.when(i % 2 == 0, "ann").otherwise("bo").alias("annotator"), verdict.alias("verdict"), (i % 4 == 0).alias("reviewed"), F.when(i % 13 != 0, n % 4 == 0).alias("judge_bad"), F.when(i % 5 != 0, 1 + n % 5).alias("helpfulness"))


@query("calibration_report", "with " + HUMAN + """, own as (select * from gold where annotator = (select annotator from names order by n desc, annotator limit 1)), c as (select max(annotator) primary_annotator, count(distinct case_id) cases_with_gold, count(judge_bad) gold_judged, count(*) - count(judge_bad) gold_unjudged, count(*) filter (reviewed) gold_reviewed,
 count(*) filter (verdict = 'hallucinated' and judge_bad) tp, count(*) filter (verdict = 'faithful' and judge_bad) fp, count(*) filter (verdict = 'faithful' and not judge_bad) tn, count(*) filter (verdict = 'hallucinated' and not judge_bad) fn, count(*) filter (verdict = 'unclear' and judge_bad is not null) excluded_unclear from own),
 e as (select *, tp + fp + tn + fn pairs, tp + fp judge_positives, tp + fn human_positives, (tp + tn) / (tp + fp + tn + fn) po, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn)) pe, round(cases_with_gold / 10000, 4) coverage from c)
 select * exclude (po, pe), round(po, 4) agreement, round(case when pe >= 1 then 0 else (po - pe) / (1 - pe) end, 4) kappa, (select count(*) from names) annotators, pairs >= 20 and coverage >= 0.5 usable,
 array_to_string(list_filter([case when (select count(*) from names) < 2 then 'one annotator' end, case when pairs > 0 and pairs < 20 then 'few pairs' end, case when coverage < 0.5 then 'low coverage' end, case when excluded_unclear > 0 then 'unclear' end, case when cases_with_gold >= 20 and gold_reviewed = 0 then 'not reviewed' end,
 case when gold_reviewed > 0 then 'reviewed' end, case when fn > 0 then 'missed' end, case when gold_unjudged > 0 then 'unjudged' end], lambda x: x is not null), ',') notes from e""")
def calibration_report(s: SparkSession, d: str) -> DataFrame:
    return X.calibration_report(human_gold(s, d), 10_000)


@query("between_annotators", "with " + HUMAN + """, b as (select x.verdict xv, y.verdict yv, abs(x.helpfulness - y.helpfulness) d from gold x join gold y on x.case_id = y.case_id and x.annotator = 'ann' and y.annotator = 'bo'),
 c as (select count(*) filter (xv <> 'unclear' and yv <> 'unclear') n, count(*) filter (xv = 'hallucinated' and yv = 'hallucinated') tp, count(*) filter (xv = 'hallucinated' and yv = 'faithful') fp, count(*) filter (xv = 'faithful' and yv = 'faithful') tn, count(*) filter (xv = 'faithful' and yv = 'hallucinated') fn,
 count(d) score_pairs, round(avg(d), 4) score_mae, round(avg((d = 0)::int), 4) score_exact_rate from b), e as (select *, (tp + tn) / n po, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) pe from c)
 select 'ann' annotator_a, 'bo' annotator_b, n binary_pairs, round(case when pe >= 1 then 0 else (po - pe) / (1 - pe) end, 4) binary_kappa, score_pairs, score_mae, score_exact_rate from e""")
def between_annotators(s: SparkSession, d: str) -> DataFrame:
    return X.between_annotators(human_gold(s, d))


# Anchors at every level: a passage as it stands, in other case and punctuation, a title, nothing, and what isn't there.
CHUNKS = "(select doc_id, i idx, substr(text, i * 450 + 1, 500) text, 'Part ' || doc_id % 7 section from (select doc_id, text, unnest(range(case when length(text) <= 500 then 1 else cast(ceil((length(text) - 500) / 450.0) as bigint) + 1 end)) i from documents where length(text) > 0))"
# Fixed value: white space and the punctuation that doesn't count when texts are compared loosely.
NORM = "lower(regexp_replace({}, '[\\s#*`>:\\-—、,，。.；;!！?？()（）\\[\\]【】\"''“”‘’]+', '', 'g'))"
ANCHORS = f"""anchors as (select doc_id qid, case when doc_id % 11 = 5 then doc_id + 1000000 else doc_id end doc, case doc_id % 5 when 0 then substr(text, 101, 60) when 1 then translate(replace(substr(text, 201, 40), ' ', ' - '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when 2 then 'Part ' || doc_id % 7 when 3 then '  ' else 'no such passage anywhere' end span from documents),
 c as {CHUNKS}, t as (select qid, doc, span, trim(span, ' ' || chr(10) || chr(9) || chr(13)) s from anchors), met as (select t.*, doc || ':' || idx point, case when s = '' then 0 when contains(section, s) then 1 when contains(text, s) then 2
 when {NORM.format('s')} <> '' and (contains({NORM.format('text')}, {NORM.format('s')}) or contains({NORM.format('section')}, {NORM.format('s')})) then 3 end lvl from t join c on c.doc_id = t.doc),
 found as (select qid, doc, span, list(point order by point) points, min(lvl) lvl from (select * from met where lvl is not null qualify lvl = min(lvl) over (partition by qid)) group by 1, 2, 3),
 mapped as (select a.qid, a.doc, a.span, coalesce(points, []) points, lvl, case when points is not null then null when a.doc not in (select doc_id from documents) then 'no document' when a.doc not in (select doc_id from c) then 'no chunks' else 'no match' end failure from anchors a left join found f on a.qid = f.qid)"""


def chunks(s: SparkSession, d: str) -> DataFrame:
    c = passages.fixed_chunks(table(s, d, "documents").select("doc_id", "text"), 500, 50)
    return c.select(F.col("doc_id").alias("doc"), F.concat_ws(":", "doc_id", "index").alias("point"), F.concat(F.lit("Part "), (F.col("doc_id") % 7).cast("string")).alias("section"), "text", "index")


def mapped(s: SparkSession, d: str) -> DataFrame:
    i, t = F.col("doc_id"), F.col("text")
    span = F.when(i % 5 == 0, F.substring(t, 101, 60)).when(i % 5 == 1, F.translate(F.replace(F.substring(t, 201, 40), F.lit(" "), F.lit(" - ")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(i % 5 == 2, F.concat(F.lit("Part "), (i % 7).cast("string"))).when(i % 5 == 3, "  ").otherwise("no such passage anywhere")
    docs = table(s, d, "documents")
    anchors = docs.select(i.alias("qid"), F.when(i % 11 == 5, i + 1_000_000).otherwise(i).alias("doc"), span.alias("span"))
    return P.mapped(anchors, chunks(s, d), docs.select(i.alias("doc")))


@query("anchor_levels", "with " + ANCHORS + " select qid, array_to_string(points, ',') points, lvl::bigint \"level\", failure from mapped")
def anchor_levels(s: SparkSession, d: str) -> DataFrame:
    return mapped(s, d).select("qid", F.array_join(F.array_sort("points"), ",").alias("points"), F.col("level").cast("long").alias("level"), "failure")


@query("anchor_coverage", "with " + ANCHORS + ", g as (select qid % 40 q, count(distinct p) n from (select qid, unnest(points) p from mapped) group by 1) select count(distinct qid % 40) cases, (select count(*) from g) mapped, (select round(avg(n), 2) from g) avg_gold_chunks, round((select count(*) from g) / count(distinct qid % 40), 4) coverage, true enough from mapped")
def anchor_coverage(s: SparkSession, d: str) -> DataFrame:
    return P.coverage(P.case_gold(mapped(s, d).withColumn("qid", F.col("qid") % 40)), 0.5)


@query("anchor_diagnostics", "with " + ANCHORS + ", z as (select doc_id, count(*) n from c group by 1) select 'gold' kind, len(points) \"value\", count(*) n from mapped group by 2 union all select 'matches', len(points), count(*) from mapped group by 2 union all select 'every chunk', z.n, count(*) from mapped m join z on z.doc_id = m.doc where z.n > 1 and len(points) = z.n group by 2 union all select 'repeated id', n, count(*) from (select least(qid, 700) q, count(*) n from anchors group by 1 having count(*) > 1) group by 2")
def anchor_diagnostics(s: SparkSession, d: str) -> DataFrame:
    """The cases' ids here are the documents', all from 700 on the same."""
    cases = table(s, d, "documents").select(F.least("doc_id", F.lit(700)).alias("qid"))
    return P.anchor_diagnostics(mapped(s, d), chunks(s, d), cases)


@query("index_report", f"with c as {CHUNKS} select (select count(*) from documents) docs, count(*) chunks, count(*) points, sum(length(text))::bigint chars, ceil(count(*) / 16)::bigint calls from c")
def index_report(s: SparkSession, d: str) -> DataFrame:
    return P.index_report(table(s, d, "documents"), P.index_points(chunks(s, d), 1, "5f45e0340000", NAMESPACE))


@query("contexts_packed", "with " + oracle.ranked("r", 64, 5) + """, h as (select qid, rank, vec_id, trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) t from r left join documents on doc_id = vec_id), b as (select *, '[' || rank || '] (' || vec_id || ')' || chr(10) || t block from h),
 l as (select qid, list(case when t = '' then null else block end order by rank) blocks from b group by 1), p as (select qid, list_reduce(blocks, lambda a, x: case when x is null then a when length(a) + case when a = '' then 0 else 2 end + length(x) <= 3000 then a || case when a = '' then '' else chr(10) || chr(10) end || x else a end, '') text, len(blocks) n from l)
 select qid, sha256(case when text = '' then '（无检索结果）' else text end) "text", length(case when text = '' then '（无检索结果）' else text end) chars from p""")
def contexts_packed(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    hits = catalog.retrieved(s, d, 64, 5).join(docs, "vec_id", "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("doc_id"), "text"))).alias("hits"))
    return hits.select("qid", P.context_bundle(F.col("hits"), 3000).alias("c")).select("qid", F.sha2("c.text", 256).alias("text"), F.col("c.chars").cast("long").alias("chars"))


TEMPLATE = "Use {contexts} and {\"json\": {\"x\": 1}}.\nQ: {question}"


@query("prompts_rendered", """select item_id, 'Use c' || item_id || ' {question} and {"json": {"x": 1}}.' || chr(10) || 'Q: ' || text prompt, substr(sha256('{"system":"s","user":' || to_json(trim(text))::varchar || '}'), 1, 16) prompt_hash,
 sha256('{"model":"m","payload":{"answer":' || to_json(text)::varchar || ',"k":' || item_id || '},"prompt_hash":"p","stage":"claims"}') cache_key, 'corpus' || item_id || '_5f45e034' collection from benchmark""")
def prompts_rendered(s: SparkSession, d: str) -> DataFrame:
    i, t = F.col("item_id"), F.col("text")
    contexts = F.concat(F.lit("c"), i.cast("string"), F.lit(" {question}"))
    payload = P.canonical_json(answer=P.json_text(t), k=P.json_number(i))
    return table(s, d, "benchmark").select("item_id", P.rendered(TEMPLATE, contexts=contexts, question=t).alias("prompt"), P.prompt_hash(F.lit(" s\n"), t).alias("prompt_hash"), P.cache_key("claims", F.lit("p"), F.lit("m"), payload).alias("cache_key"), P.collection_name(i, F.lit("5f45e03499")).alias("collection"))


@query("rubrics_parsed", "select conv_id, turn, case when length(text) % 7 between 1 and 5 then (length(text) % 7)::int end relevance, case when length(text) % 7 between 1 and 5 then 3 end helpfulness, case when length(text) % 7 not between 1 and 5 then 'bad rubric' end error from conversations")
def rubrics_parsed(s: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct((F.length("text") % 7).alias("relevance"), F.lit(3).alias("helpfulness"), F.col("text").alias("reason"), F.lit(1).alias("other")))
    rows = table(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("answer"))
    return P.rubrics(rows).drop("answer")


@query("report_csv", "with n as (select source || ', \"x\"' s, count(*) n from documents group by 1) select 0 line, 'source,n' \"text\" union all select row_number() over (order by n desc, s), '\"' || replace(s, '\"', '\"\"') || '\",' || n from n")
def report_csv(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "documents").groupBy(F.concat("source", F.lit(', "x"')).alias("s")).agg(F.count("*").alias("n"))
    return P.csv_block(n, ["source", "n"], ["s", "n"], [F.desc("n"), "s"])


@query("report_markdown", "with n as (select source || ' | x' s, count(*) n from documents group by 1) select 0 line, '| source | n |' \"text\" union all select 1, '| --- | --- |' union all select row_number() over (order by n desc, s) + 1, '| ' || replace(s, '|', '\\|') || ' | ' || n || ' |' from n")
def report_markdown(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "documents").groupBy(F.concat("source", F.lit(" | x")).alias("s")).agg(F.count("*").alias("n"))
    return P.markdown_table(n, ["source", "n"], ["s", "n"], [F.desc("n"), "s"])


@query("documents_json", "select lang, '[' || string_agg('{\"doc_id\":' || doc_id || ',\"n\":' || n_chars || '}', ',' order by doc_id) || ']' docs from documents group by 1")
def documents_json(s: SparkSession, d: str) -> DataFrame:
    docs = F.to_json(F.array_sort(F.collect_list(F.struct("doc_id", F.col("n_chars").alias("n")))))
    return table(s, d, "documents").groupBy("lang").agg(docs.alias("docs"))
