"""Queries over lists, usage, queues and whole reports, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import formats
from evalloom.functions import scoring as S
from evalloom.operators import experiments as X
from evalloom.operators import listing as L
from evalloom.operators import prompting as P
from evalloom.operators import passages, reports, retrieval, state, usage
from evalloom.plans import catalog, oracle
from evalloom.sources.tables import table

NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
Q, SQL = {}, {}


def query(name: str, sql: str):
    def add(make):
        Q[name], SQL[name] = make, sql
        return make

    return add


def state_of(column: str, states: tuple[str, ...]) -> F.Column:
    return F.get(F.array(*map(F.lit, states)), (F.col(column) % len(states)).cast("int"))


# Runs and their jobs, made of customers and orders.
RUN_STATES = ("pending", "running", "succeeded", "failed")
RUNS_SQL = """runs as (select c_custkey id, c_nationkey::bigint dataset_id, (c_nationkey % 5)::bigint project_id, ['pending','running','succeeded','failed'][c_custkey % 4 + 1] status,
 substr(sha256('cfg' || c_custkey % 7), 1, 16) config_hash from customer)"""
JOBS_SQL = "jobs as (select o_orderkey id, o_custkey run_id, ['pending','running','succeeded','failed'][o_orderkey % 4 + 1] status, o_orderdate heartbeat_at from orders)"


def runs(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("dataset_id"), (F.col("c_nationkey") % 5).cast("long").alias("project_id"), state_of("c_custkey", RUN_STATES).alias("status"), F.substring(F.sha2(F.concat(F.lit("cfg"), (F.col("c_custkey") % 7).cast("string")), 256), 1, 16).alias("config_hash"))


def jobs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id"), state_of("o_orderkey", RUN_STATES).alias("status"), F.col("o_orderdate").alias("heartbeat_at"))


@query("runs_listed", f"with {RUNS_SQL} select * from runs where dataset_id = 3 order by id desc limit 50")
def runs_listed(s: SparkSession, d: str) -> DataFrame:
    return L.newest(L.equal_if_given(runs(s, d), dataset_id=3, project_id=0, status=""), 500)


@query("single_run", f"with {RUNS_SQL} select * from runs where id = 7")
def single_run(s: SparkSession, d: str) -> DataFrame:
    return L.one(runs(s, d), id=7)


@query("documents_listed", "select doc_id, lang, source, n_chars from documents where lang = 'en'")
def documents_listed(s: SparkSession, d: str) -> DataFrame:
    return L.equal_if_given(table(s, d, "documents"), lang="en", source=None).select("doc_id", "lang", "source", "n_chars").orderBy("doc_id")


@query("candidate_runs", f"with {RUNS_SQL}, b as (select * from runs where id = 6) select r.id, r.dataset_id = b.dataset_id same_dataset, r.config_hash = b.config_hash same_config from runs r join b on r.id <> b.id where r.status = 'succeeded'")
def candidate_runs(s: SparkSession, d: str) -> DataFrame:
    r = runs(s, d)
    return L.candidates(r, L.one(r, id=6))


@query("latest_jobs", f"with {JOBS_SQL} select run_id, id, status from jobs qualify id = max(id) over (partition by run_id)")
def latest_jobs(s: SparkSession, d: str) -> DataFrame:
    return L.latest(jobs(s, d), "run_id").select("run_id", "id", "status")


@query("run_progress", f"""with {JOBS_SQL}, l as (select * from jobs qualify id = max(id) over (partition by run_id)), i as (select o_custkey run_id, count(*) total, count(*) filter (o_orderstatus = 'F') done from orders group by 1)
 select run_id, id, done, total, status = 'running' and heartbeat_at < timestamp '1998-01-01' stale, (case when total > 0 then least(done, total) || '/' || total else '—' end) progress from l join i using (run_id)""")
def run_progress(s: SparkSession, d: str) -> DataFrame:
    last = L.latest(jobs(s, d), "run_id")
    stale = state.stale(last, F.lit("1998-01-01 00:01:00").cast("timestamp"), 60).select("id", F.lit(True).alias("stale"))
    items = table(s, d, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    out = last.join(items, "run_id").join(stale, "id", "left")
    return out.select("run_id", "id", "done", "total", F.coalesce("stale", F.lit(False)).alias("stale"), formats.progress(F.col("done"), F.col("total")).alias("progress"))


# Evaluated cases with flags.
F5 = oracle.FLAGS


@query("flagged_cases", F5 + " select qid, array_to_string(flags, ',') flags from f where len(flags) > 0")
def flagged_cases(s: SparkSession, d: str) -> DataFrame:
    return L.flagged(catalog.flagged(s, d, 32, 5, True)).select("qid", F.array_join("flags", ",").alias("flags"))


@query("cases_with_flag", F5 + " select qid, round(recall, 6) recall from f where list_contains(flags, 'retrieval_partial')")
def cases_with_flag(s: SparkSession, d: str) -> DataFrame:
    return L.with_flag(catalog.flagged(s, d, 32, 5, True), "retrieval_partial").select("qid", S.rounded("recall").alias("recall"))


@query("flag_summary", F5 + " select flag, count(*) n, row_number() over (order by count(*) desc, flag) place from (select unnest(flags) flag from f) group by 1")
def flag_summary(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = catalog.flag_counts(s, d).withColumnRenamed("cases", "n")
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "flag")).cast("long"))


@query("worst_cases_cli", "with " + oracle.GOLD + ", " + oracle.run("m", 32, 5) + " select qid, round(recall, 6) recall, coalesce(first_hit_rank, 0) rank from m where recall is not null order by m.recall, -coalesce(first_hit_rank, 0), qid limit 10")
def worst_cases_cli(s: SparkSession, d: str) -> DataFrame:
    m = catalog.metrics(s, d, 32, 5).where("recall is not null").withColumn("rank", F.coalesce("first_hit_rank", F.lit(0)))
    return m.orderBy("recall", -F.col("rank"), "qid").limit(10).select("qid", S.rounded("recall").alias("recall"), "rank")


@query("case_signals", F5 + " select f.qid, coalesce('q' || c.difficulty, '') name, len(flags)::bigint n from f left join (select * from cases where category % 2 = 0) c on f.qid = c.qid")
def case_signals(s: SparkSession, d: str) -> DataFrame:
    named = catalog.cases(s, d).where("category % 2 = 0").select("qid", F.concat(F.lit("q"), F.col("difficulty").cast("string")).alias("name"))
    out = catalog.flagged(s, d, 32, 5, True).join(named, "qid", "left")
    return out.select("qid", F.coalesce("name", F.lit("")).alias("name"), F.size("flags").cast("long").alias("n"))


@query("hits_fallback", "select l_orderkey, l_linenumber, case when h = 0 and l_discount > 0.05 then 1 else h end hits from (select *, case when l_linenumber % 3 = 0 then (l_linenumber % 4)::bigint else round_even(l_tax * 10 * 0.5, 0)::bigint end h from lineitem)")
def hits_fallback(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem")
    m = F.struct(F.when(F.col("l_linenumber") % 3 == 0, (F.col("l_linenumber") % 4).cast("long")).alias("hits"), F.lit(0.5).alias("recall"), (F.col("l_tax") * 10).alias("gold_count"), F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0).alias("hit"))
    return l.select("l_orderkey", "l_linenumber", X.hits_of(m).alias("hits"))


@query("points_found", "with " + oracle.ranked("r", 32, 5) + " select qid, rank, vec_id, p.vec_id is not null \"found\", p.label from (select r.*, vec_id k from r) r left join (select vec_id, label from embeddings where vec_id % 9 <> 0) p using (vec_id)")
def points_found(s: SparkSession, d: str) -> DataFrame:
    kept = table(s, d, "embeddings").where("vec_id % 9 <> 0").select("vec_id", "label")
    return L.looked_up_points(catalog.retrieved(s, d, 32, 5), kept, "vec_id").select("qid", F.col("rank").cast("long").alias("rank"), "vec_id", "found", "label")


# Annotations of documents.
ANN_SQL = "ann as (select doc_id case_id, ['open','fixed','verified','wontfix','odd'][doc_id % 5 + 1] status, case when doc_id % 2 = 0 then 'ann' else 'bo' end annotator, 1 + (doc_id + quality) % 5 score from labels)"


def annotations(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "labels")
    return l.select(F.col("doc_id").alias("case_id"), state_of("doc_id", ("open", "fixed", "verified", "wontfix", "odd")).alias("status"), F.when(F.col("doc_id") % 2 == 0, "ann").otherwise("bo").alias("annotator"), (1 + (F.col("doc_id") + F.col("quality")) % 5).alias("score"))


def doc_cases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("case_id"))


@query("annotated_cases", f"with {ANN_SQL} select doc_id case_id, status, case when status is null then 0 when status = 'open' then 1 when status = 'fixed' then 2 when status = 'verified' then 3 when status = 'wontfix' then 4 else 5 end::bigint todo from documents left join ann on doc_id = case_id")
def annotated_cases(s: SparkSession, d: str) -> DataFrame:
    return L.pending_first(L.annotated(doc_cases(s, d), annotations(s, d)).select("case_id", "status", "todo"), "case_id")


@query("open_cases", f"with {ANN_SQL} select doc_id case_id, status from documents left join ann on doc_id = case_id where status is null or status = 'open'")
def open_cases(s: SparkSession, d: str) -> DataFrame:
    return L.still_open(L.annotated(doc_cases(s, d), annotations(s, d))).select("case_id", "status")


@query("unscored_cases", f"with {ANN_SQL} select doc_id case_id from documents where doc_id not in (select case_id from ann where annotator = 'ann')")
def unscored_cases(s: SparkSession, d: str) -> DataFrame:
    return L.unscored(doc_cases(s, d), annotations(s, d), "ann")


@query("score_validation", f"with {ANN_SQL} select coalesce(case when status not in ('open','fixed','verified','wontfix') then 'status' when score > 4 then 'score' when case_id % 3 = 2 then 'difficulty' end, 'ok') error, count(*) n from ann group by 1")
def score_validation(s: SparkSession, d: str) -> DataFrame:
    difficulty = F.get(F.array(F.lit("易"), F.lit("中"), F.lit("hard")), (F.col("case_id") % 3).cast("int"))
    error = L.first_error(status=F.col("status").isin(*S.TRANSITIONS), score=L.in_range(F.col("score"), 1, 4), difficulty=difficulty.isin(*L.DIFFICULTIES))
    return annotations(s, d).select(F.coalesce(error, F.lit("ok")).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("settings_with_defaults", """select p_partkey, coalesce(nullif(trim(case when p_partkey % 3 = 0 then '  ' when p_partkey % 3 = 1 then p_brand end), ''), 'default') model, coalesce(case when p_partkey % 2 = 0 then p_size % 3 end, 7) temperature,
 case when p_size - 10 <= 0 then 5 when p_size - 10 <= 30 then p_size - 10 end top_k from part""")
def settings_with_defaults(s: SparkSession, d: str) -> DataFrame:
    sent = F.when(F.col("p_partkey") % 3 == 0, "  ").when(F.col("p_partkey") % 3 == 1, F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", L.or_default(sent, "default").alias("model"), L.or_default(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") % 3), 7, text=False).alias("temperature"), L.resolved_top_k(F.col("p_size") - 10, most=30).alias("top_k"))


@query("answer_snippets", "with s as (select doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') t from documents) select doc_id, case when length(t) <= 40 then t else substr(t, 1, 40) || '…' end snippet from s")
def answer_snippets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", formats.snippet(F.col("text")).alias("snippet"))


@query("project_documents", "select doc_id, source from documents where source in (select source from documents group by 1 having count(*) > 10)")
def project_documents(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "source")
    return docs.join(docs.groupBy("source").count().where("count > 10").select("source"), "source", "left_semi")


@query("first_missing_anchors", "select qid, \"position\", min(doc) doc from (select l_orderkey qid, l_linenumber \"position\", l_partkey doc from lineitem where l_partkey not in (select p_partkey from part where p_size > 10) qualify l_linenumber = min(l_linenumber) over (partition by l_orderkey)) group by 1, 2")
def first_missing_anchors(s: SparkSession, d: str) -> DataFrame:
    anchors = table(s, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("doc"))
    return L.first_missing(anchors, table(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("doc")))


@query("cases_scanned", "select item_id, 2 anchors, 'd' || item_id % 9 doc, text span from benchmark")
def cases_scanned(s: SparkSession, d: str) -> DataFrame:
    anchor = lambda doc, span: F.struct(doc.alias("doc"), span.alias("span"))
    stored = F.to_json(F.array(anchor(F.concat(F.lit("d"), (F.col("item_id") % 9).cast("string")), F.col("text")), anchor(F.lit("e"), F.lit(""))))
    rows = table(s, d, "benchmark").select("item_id", F.from_json(stored, "array<struct<doc:string,span:string>>").alias("anchors"))
    return rows.select("item_id", F.size("anchors").alias("anchors"), F.get("anchors", F.lit(0))["doc"].alias("doc"), F.get("anchors", F.lit(0))["span"].alias("span"))


@query("inserted_documents", "select item_id, case when trim(substr(text, 1, item_id % 4)) = '' then 'blank title' when count(*) over (partition by item_id // 2 + (item_id % 5 = 0)::int) > 1 then 'repeated key' when (item_id // 2 + (item_id % 5 = 0)::int) % 7 = 3 then 'stored key' end error from benchmark")
def inserted_documents(s: SparkSession, d: str) -> DataFrame:
    new = table(s, d, "benchmark").select("item_id", (F.expr("item_id div 2") + (F.col("item_id") % 5 == 0).cast("long")).alias("key"), F.substring(F.col("text"), F.lit(1), (F.col("item_id") % 4).cast("int")).alias("title"))
    return L.inserted(new, s.range(10_000).where("id % 7 = 3").withColumnRenamed("id", "key"), "key", ["title"]).select("item_id", "error")


@query("project_pairs", "select o_custkey dataset_id, o_orderkey corpus_id, case when c_custkey is null then 'no dataset' when p_partkey is null then 'no corpus' when c_nationkey % 3 <> p_size % 3 then 'other project' end error from orders left join (select * from customer where c_custkey % 10 <> 0) on o_custkey = c_custkey left join part on p_partkey = o_orderkey")
def project_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = table(s, d, "orders").select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("corpus_id"))
    datasets = table(s, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("dataset_id"), (F.col("c_nationkey") % 3).alias("project_id"))
    return L.same_project(pairs, datasets, table(s, d, "part").select(F.col("p_partkey").alias("corpus_id"), (F.col("p_size") % 3).alias("project_id"))).select("dataset_id", "corpus_id", "error")


@query("project_owners", "select c_custkey, lower(trim(s_name)) owner from customer left join supplier on s_suppkey = c_custkey % 150")
def project_owners(s: SparkSession, d: str) -> DataFrame:
    users = table(s, d, "supplier").select(F.col("s_suppkey").alias("owner_id"), L.canonical_email(F.col("s_name")).alias("owner"))
    return table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 150).alias("owner_id")).join(users, "owner_id", "left").select("c_custkey", "owner")


@query("user_counts", "select count(*) users, count(*) filter (c_mktsegment = 'BUILDING' and c_acctbal > 0) active_admins from customer")
def user_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").agg(F.count("*").alias("users"), F.count_if((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0)).alias("active_admins"))


@query("cache_stats", "select count(*) entries, coalesce(sum(length(text)), 0)::bigint hits from conversations")
def cache_stats(s: SparkSession, d: str) -> DataFrame:
    return usage.cache_stats(table(s, d, "conversations").select(F.length("text").alias("hits")))


@query("usage_merged", "select user_id, count(*) calls, sum(event_id)::bigint tokens from events group by 1")
def usage_merged(s: SparkSession, d: str) -> DataFrame:
    return usage.merged_usage(table(s, d, "events").select("user_id", F.lit(1).alias("calls"), F.col("event_id").alias("tokens")), ["calls", "tokens"], ["user_id"])


@query("heat_map", "with " + oracle.SCORED + ", c as (select human h, judge j, count(*) n from scored group by 1, 2) select h, j, n, n / max(n) over () intensity from c")
def heat_map(s: SparkSession, d: str) -> DataFrame:
    cells = reports.confusion(catalog.scored(s, d), "judge", "human").where("n > 0")
    most = cells.agg(F.max("n").alias("most"))
    return cells.join(F.broadcast(most), F.lit(True)).select("h", "j", "n", formats.intensity(F.col("n"), F.col("most")).alias("intensity"))


@query("metric_keys", "select user_id, array_to_string(list_sort(list(distinct event_type)), ',') \"all\", array_to_string(list_sort(coalesce(list(distinct event_type) filter (event_type <> 'click'), [])), ',') counted from events group by 1")
def metric_keys(s: SparkSession, d: str) -> DataFrame:
    keys = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("keys"))
    return keys.select("user_id", F.array_join("keys", ",").alias("all"), F.array_join(F.array_except("keys", F.array(F.lit("click"))), ",").alias("counted"))


# Generated and judged answers: whole conversations as claims.
ANSWERS_SQL = """turns as (select conv_id, text, length(text) n from conversations), judged as (select conv_id, list(n % 3 order by n) labels, count(*) claims, count(*) filter (n % 3 = 0) supported, count(*) filter (n % 3 = 1) unsupported,
 count(*) filter (n % 3 = 2) irrelevant, sum(n)::bigint total, max(n) mx, 1 + max(n) % 5 top from turns group by 1)"""


def answers(s: SparkSession, d: str) -> DataFrame:
    """A row for each conversation with ``answer``, ``generation`` and, for two of three, ``judge``."""
    n = F.length("text").cast("long")
    label = F.get(F.array(*map(F.lit, usage.LABELS)), (F.col("n") % 3).cast("int"))
    rows = table(s, d, "conversations").select("conv_id", n.alias("n")).groupBy("conv_id").agg(F.collect_list(F.struct(label.alias("label"))).alias("claims"), F.sum("n").alias("total"), F.max("n").alias("top"))
    meta = F.struct(F.lit(1).alias("claims_calls"), (F.col("conv_id") % 2).alias("rubric_calls"), (F.col("conv_id") % 3).alias("claims_cache_hits"), F.lit(0).alias("rubric_cache_hits"), F.col("total").alias("prompt_tokens"), F.col("top").alias("completion_tokens"), F.lit(0).alias("cache_saved_prompt_tokens"), F.lit(None).cast("int").alias("cache_saved_completion_tokens"))
    rubric = F.when(F.col("conv_id") % 4 != 0, F.struct((1 + F.col("total") % 5).alias("relevance"), (1 + F.col("top") % 5).alias("helpfulness")))
    judge = F.when(F.col("conv_id") % 3 != 0, F.struct("claims", rubric.alias("rubric"), meta.alias("meta")))
    generation = F.when(F.col("conv_id") % 5 != 0, F.struct(F.col("total").alias("prompt_tokens"), F.when(F.col("conv_id") % 2 == 0, F.col("top")).alias("completion_tokens")))
    return rows.select("conv_id", F.when(F.col("conv_id") % 7 != 0, F.lit("text")).otherwise("").alias("answer"), generation.alias("generation"), judge.alias("judge"))


@query("generation_usage", f"with {ANSWERS_SQL} select count(*) filter (conv_id % 7 <> 0) answers_generated, coalesce(sum(total) filter (conv_id % 5 <> 0), 0)::bigint prompt_tokens, coalesce(sum(mx) filter (conv_id % 5 <> 0 and conv_id % 2 = 0), 0)::bigint completion_tokens from judged")
def generation_usage(s: SparkSession, d: str) -> DataFrame:
    return usage.generation_usage(answers(s, d))


JUDGE_SQL = f"""with {ANSWERS_SQL}, j as (select * from judged where conv_id % 3 <> 0), u as (select coalesce(sum(claims), 0)::bigint claims_total, coalesce(sum(supported), 0)::bigint claims_supported,
 coalesce(sum(unsupported), 0)::bigint claims_unsupported, coalesce(sum(irrelevant), 0)::bigint claims_irrelevant, count(*) cases_judged, count(*) rubric_cases, count(*) filter (conv_id % 4 <> 0) rubric_scored_cases, count(*) judge_claims_calls,
 coalesce(sum(conv_id % 2), 0)::bigint judge_rubric_calls, coalesce(sum(conv_id % 3), 0)::bigint judge_cache_hits, coalesce(sum(total), 0)::bigint judge_prompt_tokens, coalesce(sum(mx), 0)::bigint judge_completion_tokens, 0 judge_cache_saved_prompt_tokens,
 0 judge_cache_saved_completion_tokens, round(coalesce(avg(1 + total % 5) filter (conv_id % 4 <> 0), 0), 4) relevance_avg, round(coalesce(avg(top) filter (conv_id % 4 <> 0), 0), 4) helpfulness_avg from j)"""


@query("judge_usage_whole", JUDGE_SQL + " select * from u")
def judge_usage_whole(s: SparkSession, d: str) -> DataFrame:
    return usage.judge_usage(answers(s, d))


@query("rubric_keys", "select count(*) filter (conv_id % 7 <> 0 and conv_id % 4 in (1, 2)) rubric_cases, count(*) filter (conv_id % 7 <> 0 and conv_id % 4 = 2) rubric_scored_cases from conversations")
def rubric_keys(s: SparkSession, d: str) -> DataFrame:
    """Judgements without a rubric, with an empty one, with one, broken ones, and none."""
    i = F.col("conv_id")
    said = F.to_json(F.struct(F.array(F.struct("text")).alias("claims"), F.struct(F.lit(3).alias("relevance")).alias("rubric")))
    empty = F.concat(F.lit('{"rubric": null, "claims": '), F.to_json(F.array("text")), F.lit("}"))
    judge = F.when(i % 7 != 0, F.when(i % 4 == 0, "{}").when(i % 4 == 1, empty).when(i % 4 == 2, said).otherwise('{"rubric": '))
    return usage.rubric_counts(table(s, d, "conversations").select(judge.alias("judge")))


@query("run_rates", JUDGE_SQL + " select round(claims_supported / claims_total, 6) claim_support_rate, round(claims_unsupported / claims_total, 6) hallucination_rate, round(claims_irrelevant / claims_total, 6) irrelevant_rate, round(claims_total / cases_judged, 4) avg_claims_per_answer, true judged, true rates_consistent from u")
def run_rates(s: SparkSession, d: str) -> DataFrame:
    return usage.run_rates(usage.judge_usage(answers(s, d))).select("claim_support_rate", "hallucination_rate", "irrelevant_rate", "avg_claims_per_answer", "judged", "rates_consistent")


@query("claim_labels", f"""with {ANSWERS_SQL} select conv_id, case when conv_id % 3 <> 0 then claims else 0 end claims, case when conv_id % 3 <> 0 then supported else 0 end supported, case when conv_id % 3 = 0 then '共 0 条断言（答案没有可核查的断言）' else
 '共 ' || claims || ' 条断言：supported ' || supported || ' / unsupported ' || unsupported || ' / irrelevant ' || irrelevant end summary from judged""")
def claim_labels(s: SparkSession, d: str) -> DataFrame:
    counts = usage.label_counts(F.col("judge.claims"))
    return answers(s, d).select("conv_id", counts["claims"].alias("claims"), counts["supported"].alias("supported"), formats.claims_summary(counts).alias("summary"))


@query("rubric_scores", "select l_orderkey, l_linenumber, case when l_quantity / 10 - 1 > 0 then least(floor(l_quantity / 10 - 1 + 0.5), 5)::int end score from lineitem")
def rubric_scores(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", usage.rubric_score(F.col("l_quantity") / 10 - 1).alias("score"))


@query("formatted", """select p_partkey, printf('%.1f%%', p_size / 50 * 100) share, case when p_size > 25 then '+' else '' end || printf('%.1fpp', (p_size - 25) / 50 * 100) delta, case when p_size / 50 <= 1 then printf('%.0f%%', p_size / 50 * 100) else printf('%.2f', p_size / 50) end evidence,
 case when p_size = 0 then '—' else p_size || ' → ' || 3 end shift, case when abs((p_size - 25) / 50) < 0.05 then '基本无偏' when p_size > 25 then 'judge 偏宽松 ' || printf('%.2f', abs((p_size - 25) / 50)) || ' 分' else 'judge 偏严格 ' || printf('%.2f', abs((p_size - 25) / 50)) || ' 分' end bias,
 p_brand || ' · ' || p_size || '+0 tokens' || case when p_size > 20 then ' · ' || printf('%.1fs', p_size * 100 / 1000) else '' end generation from part""")
def formatted(s: SparkSession, d: str) -> DataFrame:
    share, delta = F.col("p_size") / 50, (F.col("p_size") - 25) / 50
    latency = F.when(F.col("p_size") > 20, F.col("p_size") * 100)
    return table(s, d, "part").select("p_partkey", formats.percent(share).alias("share"), formats.points(delta).alias("delta"), formats.evidence_value(share).alias("evidence"), formats.shift(F.col("p_size"), F.lit(3)).alias("shift"), formats.bias_text(delta).alias("bias"), formats.generation_summary(F.col("p_brand"), F.col("p_size"), F.lit(None).cast("int"), latency).alias("generation"))


@query("settings_changed", "select a.p_partkey, array_to_string(list_filter([case when a.p_brand <> b.p_brand then 'p_brand: ' || a.p_brand || ' → ' || b.p_brand end, case when a.p_size <> b.p_size then 'p_size: ' || a.p_size || ' → ' || b.p_size end], lambda x: x is not null), '; ') changes from part a join part b on b.p_partkey = a.p_partkey + 1")
def settings_changed(s: SparkSession, d: str) -> DataFrame:
    row = table(s, d, "part").select("p_partkey", F.struct("p_brand", "p_size").alias("a"))
    after = row.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return row.join(after, "p_partkey").select("p_partkey", F.array_join(formats.config_changes(F.col("a"), F.col("b"), ["p_brand", "p_size"]), "; ").alias("changes"))


# The queue.
ITEMS = oracle.ITEMS


@query("claimed_items", f"with {ITEMS}, n as (select *, row_number() over (partition by job_id, status order by case_id) r from items) select job_id, case_id, case when status = 'pending' and r <= 8 then 'running' else status end status from n")
def claimed_items(s: SparkSession, d: str) -> DataFrame:
    return state.claimed(catalog.items(s, d), 8).select("job_id", "case_id", "status")


@query("released_items", f"with {ITEMS} select case_id, case when status = 'running' and case_id % 3 = 0 then 'pending' else status end status from items")
def released_items(s: SparkSession, d: str) -> DataFrame:
    i = catalog.items(s, d)
    return state.released(i, i.where("case_id % 3 = 0")).select("case_id", "status")


@query("retried_items", f"with {ITEMS} select case_id, case when status = 'running' then case when retry_count + 1 >= 3 then 'failed' else 'pending' end else status end status, case when status = 'running' then retry_count + 1 else retry_count end retry_count, case when status = 'running' then length(repeat('e', 600)) - 100 end error_chars from items")
def retried_items(s: SparkSession, d: str) -> DataFrame:
    i = catalog.items(s, d).withColumn("last_error", F.lit(None).cast("string"))
    out = state.retried(i, i.where("status = 'running'").select("case_id", F.repeat(F.lit("e"), 600).alias("error")))
    return out.select("case_id", "status", "retry_count", F.length("last_error").cast("long").alias("error_chars"))


@query("reclaimed_items", f"with {ITEMS} select case_id, case when status = 'running' and job_id < 20 then 'pending' else status end status from items")
def reclaimed_items(s: SparkSession, d: str) -> DataFrame:
    i = catalog.items(s, d)
    gone = i.where("job_id < 20").select("job_id").distinct().select("job_id", F.lit("running").alias("status"), F.lit(None).cast("timestamp").alias("heartbeat_at"))
    return state.reclaimed(i, state.stale(gone, F.lit("1998-01-01").cast("timestamp"), 60)).select("case_id", "status")


@query("releasable_jobs", f"with {ITEMS} select distinct job_id from items where job_id % 2 = 0 and job_id not in (select job_id from items where status = 'running' and case_id % 40 = 1)")
def releasable_jobs(s: SparkSession, d: str) -> DataFrame:
    i = catalog.items(s, d)
    own = i.where("job_id % 2 = 0").select("job_id", F.lit("running").alias("status")).distinct()
    return state.releasable(own, i.where("case_id % 40 = 1")).select("job_id")


@query("finished_jobs", f"with {ITEMS} select job_id, case when count(*) filter (status <> 'succeeded') > 0 then 'failed' else 'succeeded' end status from items where job_id % 3 = 0 or status = 'succeeded' group by 1")
def finished_jobs(s: SparkSession, d: str) -> DataFrame:
    return state.finished(catalog.items(s, d).where("job_id % 3 = 0 or status = 'succeeded'"))


@query("enqueued_items", "select 9 run_id, doc_id case_id, 'pending' status, 0 retry_count from documents")
def enqueued_items(s: SparkSession, d: str) -> DataFrame:
    return state.enqueued(doc_cases(s, d), 9).select("run_id", "case_id", "status", "retry_count")


@query("resumed_items", f"with {ITEMS} select case_id from items where status <> 'succeeded'")
def resumed_items(s: SparkSession, d: str) -> DataFrame:
    i = catalog.items(s, d)
    return state.pending(i.select("case_id"), i.where("status = 'succeeded'"), ["case_id"])


@query("results_upserted", "select doc_id, case when doc_id % 4 = 0 then -n_chars else n_chars end n from documents union all select max(doc_id) + 1, 5 from documents")
def results_upserted(s: SparkSession, d: str) -> DataFrame:
    stored = table(s, d, "documents").select("doc_id", F.col("n_chars").alias("n"))
    extra = stored.agg((F.max("doc_id") + 1).alias("doc_id"), F.lit(5).cast("long").alias("n"))
    return state.upserted(stored, stored.where("doc_id % 4 = 0").select("doc_id", (-F.col("n")).alias("n")).unionByName(extra), ["doc_id"])


@query("flags_updated", F5 + " select qid, case when qid % 20 = 0 then 'none' else array_to_string(flags, ',') end flags from f")
def flags_updated(s: SparkSession, d: str) -> DataFrame:
    f = catalog.flagged(s, d, 32, 5, True).select("qid", F.array_join("flags", ",").alias("flags"))
    return L.updated(f, f.where("qid % 20 = 0").select("qid", F.lit("none").alias("flags")), "qid", "flags")
