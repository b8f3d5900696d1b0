"""The queries by name, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import scoring as S
from evalloom.operators import listing, passages, reports, retrieval, state
from evalloom.plans import oracle
from evalloom.sources.scratch import written
from evalloom.sources.tables import json_lines, table
from evalloom.streaming.queue import windowed

Query = Callable[[SparkSession, str], DataFrame]


# The simulated evaluation: vectors whose id ends in 0 ask, the first dimensions retrieve, all of them are gold.
def asking(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 10 = 0")


def cases(spark: SparkSession, d: str) -> DataFrame:
    return asking(spark, d).select(F.col("vec_id").alias("qid"), F.col("label").alias("category"), (F.expr("vec_id div 10") % 3).alias("difficulty"))


def retrieved(spark: SparkSession, d: str, dims: int, k: int) -> DataFrame:
    return retrieval.top_k(table(spark, d, "embeddings"), asking(spark, d), dims, k)


def searched(spark: SparkSession, d: str, *dims: int) -> DataFrame:
    """(dims, qid, vec_id, score, rank): the five nearest by each number of dimensions, and by all 64, written as a run's results are: reports read them as often as they like."""
    found = [retrieved(spark, d, n, 5).withColumn("dims", F.lit(n)) for n in sorted({*dims, 64})]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return written(out, "hits")


def hits(spark: SparkSession, d: str, dims: int, k: int, found: DataFrame | None = None) -> DataFrame:
    """What was retrieved by a number of dimensions, from ``searched`` if that is given."""
    return retrieved(spark, d, dims, k) if found is None else found.where((F.col("dims") == dims) & (F.col("rank") <= k)).drop("dims")


def gold(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    size = 1 + F.expr("qid div 10") % 3
    return hits(spark, d, 64, 3, found).where((F.col("rank") <= size) & (F.col("qid") % 70 != 0)).select("qid", "vec_id")


def metrics(spark: SparkSession, d: str, dims: int, k: int, found: DataFrame | None = None) -> DataFrame:
    return retrieval.case_metrics(cases(spark, d), hits(spark, d, dims, k, found), gold(spark, d, found), k)


def run_metrics(spark: SparkSession, d: str, found: DataFrame, runs: dict[int, tuple[int, int]]) -> DataFrame:
    """Case metrics of several runs (run_id: dimensions and k) in one go, with run_id and k."""
    each = spark.createDataFrame([(i, *v) for i, v in runs.items()], "run_id int, dims int, k int")
    every = F.broadcast(each.select("run_id", "k"))
    got = found.join(F.broadcast(each), "dims").drop("dims")
    return retrieval.case_metrics(cases(spark, d).crossJoin(every), got, gold(spark, d, found).crossJoin(every.select("run_id")), "k", by=("run_id", "qid"))


def shown(m: DataFrame) -> DataFrame:
    """Case metrics as they are written."""
    return m.withColumns({c: S.rounded(F.col(c)) for c in ("recall", "precision", "reciprocal_rank")})


def claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim for each turn of conversation qid / 10: its label by its length."""
    turns = table(spark, d, "conversations")
    return turns.select((F.col("conv_id") * 10).alias("qid"), "turn", F.length("text").cast("long").alias("n"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("n") % 3
    return claims(spark, d).groupBy("qid").agg(
        F.count("*").alias("claims"), F.count_if(label == 0).alias("supported"), F.count_if(label == 1).alias("unsupported"), F.count_if(label == 2).alias("irrelevant"), (1 + F.sum("n") % 5).alias("relevance"), (1 + F.max("n") % 5).alias("helpfulness")
    )


def flagged(spark: SparkSession, d: str, dims: int, k: int, with_judge: bool = False, found: DataFrame | None = None) -> DataFrame:
    m = metrics(spark, d, dims, k, found)
    if with_judge:
        m = m.join(judged(spark, d), "qid", "left")
        judge = F.when(F.col("claims").isNotNull(), F.struct("claims", "unsupported", "irrelevant", "relevance", "helpfulness"))
    else:
        judge = F.lit(None).cast(NOT_JUDGED)
    return m.withColumn("flags", S.flags(F.struct("gold_count", "hits", "first_hit_rank"), judge, k))


NOT_JUDGED = "struct<claims:bigint,unsupported:bigint,irrelevant:bigint,relevance:bigint,helpfulness:bigint>"


def stored_flags(spark: SparkSession, d: str, found: DataFrame, runs: dict[int, tuple[int, int]]) -> DataFrame:
    """``run_metrics`` with the flags that retrieval alone can give, written."""
    m = run_metrics(spark, d, found, runs)
    return written(m.withColumn("flags", S.flags(F.struct("gold_count", "hits", "first_hit_rank"), F.lit(None).cast(NOT_JUDGED), F.col("k"))), "runs")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = stored_flags(spark, d, searched(spark, d, 48), {1: (48, 1), 2: (48, 5)})
    both = reports.paired(rows.where("run_id = 1"), rows.where("run_id = 2"))
    return both.join(cases(spark, d), "qid")


def attribution(spark: SparkSession, d: str) -> DataFrame:
    out = flagged(spark, d, 32, 5, True)
    return out.select("qid", F.array_join("flags", ",").alias("flags"), S.reason(F.col("flags")).alias("reason"))


def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d, 32, 5, True).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("cases"))


def worst(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d, 32, 5).where("recall is not null").orderBy("recall", "qid").limit(10).select("qid", S.rounded("recall").alias("recall"), S.rounded("reciprocal_rank").alias("reciprocal_rank"))


def k_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    m = run_metrics(spark, d, searched(spark, d, 32), {k: (32, k) for k in (1, 3, 5)})
    return retrieval.run_aggregates(m)


def strata(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    one = reports.strata(p, F.col("category")).withColumn("by", F.lit("category"))
    return one.unionByName(reports.strata(p, F.col("difficulty")).withColumn("by", F.lit("difficulty")))


def recall_differences(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return p.select("category", (F.col("r_recall") - F.col("l_recall")).alias("d"))


def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return reports.signed_ranks(recall_differences(spark, d), ["category"])


def wilcoxon_exact(spark: SparkSession, d: str) -> DataFrame:
    return reports.exact_p(recall_differences(spark, d), ["category"])


def judge_usage(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    total = F.sum("claims")
    return j.agg(F.count("*").alias("cases_judged"), total.alias("claims"), F.sum("supported").alias("supported"), F.sum("unsupported").alias("unsupported"), F.sum("irrelevant").alias("irrelevant"), S.rounded(F.try_divide(F.sum("unsupported"), total)).alias("hallucination_rate"), S.rounded(total / F.count("*"), 4).alias("avg_claims_per_answer"), S.rounded(F.avg("relevance"), 4).alias("relevance_avg"), S.rounded(F.avg(F.try_divide("unsupported", "claims"))).alias("macro_rate"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Human labels beside a judge that looks at lengths."""
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels")
    j = labels.join(docs, "doc_id")
    human = F.when(F.col("doc_id") % 17 != 0, F.col("toxic") == 1)
    return j.select("doc_id", human.alias("human_bad"), (F.col("n_chars") % 4 == 0).alias("judge_bad"), (1 + F.col("n_chars") % 5).cast("long").alias("judge"), (1 + (F.col("n_chars") + F.col("quality") + F.col("toxic")) % 5).cast("long").alias("human"), F.when(F.col("doc_id") % 2 == 0, "ann").otherwise("bo").alias("annotator"), F.expr("doc_id div 2").alias("pair"))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    out = reports.binary_calibration(scored(spark, d), F.col("judge_bad"), F.col("human_bad"))
    return out.withColumn("band", S.kappa_band(F.col("kappa")))


def disagreements(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where("human_bad <> judge_bad")
    return s.select("doc_id", F.when(F.col("human_bad"), "missed").otherwise("false_alarm").alias("kind")).orderBy(F.desc("kind"), "doc_id").limit(50)


def inter_annotator(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    a, b = (s.where(F.col("annotator") == n).select("pair", F.col("human").alias(c)) for n, c in (("ann", "x"), ("bo", "y")))
    return a.join(b, "pair").agg(F.count("*").alias("pairs"), S.rounded(F.avg(F.abs(F.col("x") - F.col("y"))), 4).alias("mae"), S.rounded(F.avg((F.col("x") == F.col("y")).cast("double")), 4).alias("exact_rate"))


def closure(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, ("open", "fixed", "verified", "wontfix"))), (F.expr("qid div 10") % 4).cast("int"))
    rows = stored_flags(spark, d, searched(spark, d, 48), {1: (48, 1), 2: (48, 5)})
    return reports.closure(cases(spark, d).select("qid", status.alias("status")), rows.where("run_id = 1"), rows.where("run_id = 2 and qid % 130 <> 0"))


def closure_summary(spark: SparkSession, d: str) -> DataFrame:
    return closure(spark, d).groupBy("verdict").agg(F.count("*").alias("cases"), F.count_if("eligible").alias("eligible"))


def consistency(spark: SparkSession, d: str) -> DataFrame:
    found = searched(spark, d, 48)

    def run(dims: int, part: str) -> DataFrame:
        ids = hits(spark, d, dims, 5, found).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
        return ids.join(flagged(spark, d, dims, 5, found=found).select("qid", "flags"), "qid").where(part)

    return reports.consistency(run(48, "qid % 110 <> 0"), run(64, "qid % 130 <> 0"))


def score_noise(spark: SparkSession, d: str) -> DataFrame:
    a, b = (retrieved(spark, d, n, 5).select("qid", "vec_id", F.col("score").alias(c)) for n, c in ((62, "x"), (64, "y")))
    return reports.score_noise(a.join(b, ["qid", "vec_id"]).select((F.col("x") - F.col("y")).alias("d")), "d")


def items(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("running")
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("job_id"), F.col("o_orderkey").alias("case_id"), status.alias("status"), (F.col("o_orderkey") % 4).alias("retry_count"))


def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).where((F.col("status") == "failed") & (F.col("retry_count") + 1 >= 3)).groupBy("job_id").agg(F.count("*").alias("dead"))


def stale_workers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    jobs = e.groupBy("user_id").agg(F.max("ts").alias("heartbeat_at")).withColumn("status", F.lit("running"))
    now = F.timestamp_seconds(F.lit(1735689600))
    return state.stale(jobs, now, 86400 * 2).select("user_id", F.unix_timestamp("heartbeat_at").alias("heartbeat"))


def upserted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return state.last_wins(e, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", "value")


def cached(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return state.first_wins(e, ["user_id"], ["event_id"])


def merged(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("verdict"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("score"))
    return state.merged(e, ["user_id"], F.col("event_id"), ["verdict", "score"])


def patches(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels")
    sent = F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 1, F.col("doc_id") % 5 + 1)
    return l.select("doc_id", state.patched(F.col("quality").cast("long"), sent.cast("long")).alias("quality"))


def annotation_stats(spark: SparkSession, d: str) -> DataFrame:
    f = flagged(spark, d, 32, 5).select(F.get(F.array(*map(F.lit, ("open", "fixed", "verified", "wontfix"))), (F.expr("qid div 10") % 4).cast("int")).alias("status"), F.coalesce(F.nullif(S.reason(F.col("flags")), F.lit("")), F.lit("unclassified")).alias("reason"))
    kind = F.when(F.grouping("status") == 0, "status").otherwise("reason")
    counts = f.groupingSets([["status"], ["reason"]], "status", "reason").agg(kind.alias("kind"), F.count("*").alias("n"))
    return counts.select("kind", F.coalesce("status", "reason").alias("value"), "n")


def state_machine(spark: SparkSession, d: str) -> DataFrame:
    states = ("open", "fixed", "verified", "wontfix")
    pick = lambda e: F.get(F.array(*map(F.lit, states)), (e % 4).cast("int"))
    e = table(spark, d, "events").select(pick(F.col("event_id")).alias("old"), pick(F.expr("event_id div 4")).alias("new"))
    return e.groupBy("old", "new").agg(F.count("*").alias("n")).withColumn("valid", S.valid_transition(F.col("old"), F.col("new")))


def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    return passages.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"), 500, 50)


def structured(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose first line of each three is a heading."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^([^\n]*\n[^\n]*\n[^\n]*\n)", "## $1\n").alias("text"))
    chunks = passages.chunked(docs).select("doc_id", F.explode("chunks").alias("c"))
    return chunks.select("doc_id", "c.index", "c.char_start", "c.char_end", "c.section")


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the benchmark found in the chunks of the documents that hold them; chunks overlap by 400 characters, more than the longest passage has."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("span"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = passages.holding(items, docs.withColumnRenamed("doc_id", "doc"))
    held = docs.join(found.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chunks = passages.fixed_chunks(held, 500, 400).select(F.col("doc_id").alias("doc"), F.concat_ws(":", "doc_id", "index").alias("point"), F.lit("").alias("section"), "text")
    return passages.anchored(found, chunks).select("qid", "doc", "point", F.col("level").cast("long").alias("level"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the retrieved documents, by rank and place, as far as the budget goes; ranks count chunks."""
    r = retrieved(spark, d, 64, 5).select("qid", "rank", F.col("vec_id").alias("doc_id"))
    chunks = passages.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"), 500, 50)
    blocks = r.join(chunks, "doc_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "index", "text"))).alias("blocks"))
    ranked = blocks.select("qid", F.transform("blocks", lambda b, i: F.struct((i + 1).alias("rank"), b["text"].alias("text"))).alias("ranked"))
    return ranked.select("qid", passages.context(F.col("ranked"), 2000).alias("c")).select("qid", F.col("c.used").cast("long").alias("used"), F.array_join("c.ranks", ",").alias("ranks"))


def protocol(spark: SparkSession, d: str) -> DataFrame:
    label = F.get(F.array(*map(F.lit, ("supported", "unsupported", "irrelevant", "odd"))), (F.length("text") % 4).cast("int"))
    body = F.to_json(F.struct(F.array(F.struct(F.col("text"), label.alias("label"))).alias("claims")))
    answers = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Here: {not json} "), body, F.lit(" end")).alias("answer"))
    return passages.claims(answers).select("conv_id", "turn", F.to_json("claims").alias("claims"), "error")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    canonical = F.to_json(F.struct(F.col("doc_id"), F.col("lang"), F.col("n_chars")))
    return docs.select("doc_id", F.sha2(canonical, 256).alias("config_hash"), F.substring(F.sha2(F.trim("text"), 256), 1, 16).alias("prompt_hash"))


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.point_id("6ba7b8109dad11d180b400c04fd430c8", F.concat(F.lit("corpus1:"), F.col("doc_id").cast("string"))).alias("point_id"))


def imported(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines with planted faults: bad JSON, blank questions, repeated ids."""
    qid = F.when(F.col("item_id") % 7 == 3, F.lit("q0")).otherwise(F.concat(F.lit("q"), F.col("item_id").cast("string")))
    body = F.to_json(F.struct(qid.alias("qid"), F.when(F.col("item_id") % 5 == 2, " ").otherwise(F.col("text")).alias("question")))
    lines = table(spark, d, "benchmark").select((F.col("item_id") + 1).alias("line"), F.when(F.col("item_id") % 11 == 6, "{broken").otherwise(body).alias("value"))
    rows = json_lines(lines, "qid string, question string")
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.trim("question") == "", "blank question")))
    first = rows.where("error is null").groupBy("qid").agg(F.min("line").alias("first"))
    rows = rows.join(first, "qid", "left").withColumn("error", F.coalesce("error", F.when(F.col("line") > F.col("first"), "duplicate qid")))
    return rows.select("line", F.coalesce("error", F.lit("imported")).alias("outcome"))


def case_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = listing.counted_children(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey")
    return counted.withColumnRenamed("n", "case_count")


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    snippet = F.nullif(F.trim(F.regexp_replace("text", r"[ \n]+", " ")), F.lit(""))
    return docs.select("doc_id", S.csv_cell(snippet).alias("cell"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    out = windowed(table(spark, d, "events"))
    return out.select(F.unix_timestamp("window_start").alias("start"), "event_type", "n", S.rounded("total", 2).alias("total"))


QUERIES: dict[str, Query] = {
    "knn_topk": lambda s, d: retrieved(s, d, 64, 5).select("qid", "vec_id", S.rounded("score").alias("score"), F.col("rank").cast("long").alias("rank")),
    "case_metrics_k5": lambda s, d: shown(metrics(s, d, 32, 5)),
    "case_metrics_k1": lambda s, d: shown(metrics(s, d, 48, 1)),
    "run_aggregate": lambda s, d: retrieval.run_aggregate(metrics(s, d, 32, 5), 5),
    "k_sensitivity": k_sensitivity,
    "attribution_flags": attribution,
    "flag_counts": flag_counts,
    "worst_cases": worst,
    "ab_summary": lambda s, d: reports.summary(pairs(s, d)),
    "ab_transitions": lambda s, d: reports.transitions(pairs(s, d)),
    "ab_strata": strata,
    "ab_strata_flag": lambda s, d: reports.strata_by_flag(pairs(s, d)),
    "wilcoxon": wilcoxon,
    "wilcoxon_exact": wilcoxon_exact,
    "judge_usage": judge_usage,
    "calibration_binary": calibration,
    "calibration_scores": lambda s, d: reports.score_calibration(scored(s, d), "judge", "human"),
    "confusion_5x5": lambda s, d: reports.confusion(scored(s, d), "judge", "human"),
    "inter_annotator": inter_annotator,
    "disagreements": disagreements,
    "closure_records": closure,
    "closure_summary": closure_summary,
    "run_consistency": consistency,
    "score_noise": score_noise,
    "job_progress": lambda s, d: state.progress(items(s, d), "job_id", "status"),
    "dead_letters": dead_letters,
    "stale_workers": stale_workers,
    "upsert_last_wins": upserted,
    "cache_first_wins": cached,
    "merge_coalesce": merged,
    "patch_clear": patches,
    "annotation_stats": annotation_stats,
    "state_machine": state_machine,
    "fixed_chunks": chunk_docs,
    "heading_chunks": structured,
    "anchor_mapping": anchors,
    "context_packing": contexts,
    "json_protocol": protocol,
    "fingerprints": fingerprints,
    "point_ids": point_ids,
    "import_report": imported,
    "dataset_case_count": case_counts,
    "report_export_rows": export_rows,
    "hourly_events": hourly,
}


def parts() -> list:
    """The modules that have more queries (``Q``) and their SQL."""
    from evalloom.plans import chunks, comparisons, evaluation, judged, search, streams, whole

    return [evaluation, comparisons, judged, search, streams, chunks, whole]


def queries() -> dict[str, Query]:
    return QUERIES | {name: make for part in parts() for name, make in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | {name: sql for part in parts() for name, sql in part.SQL.items()}
