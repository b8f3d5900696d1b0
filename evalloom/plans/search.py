"""Queries that evaluate retrieval from documents alone, and approximate search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import scoring as S
from evalloom.operators import ann, offline, passages, retrieval
from evalloom.plans import oracle
from evalloom.sources.scratch import written
from evalloom.sources.tables import table

Q, SQL = {}, {}


def query(name: str, sql: str):
    def add(make):
        Q[name], SQL[name] = make, sql
        return make

    return add


# Benchmark passages ask; the chunks that hold them are gold.
K, SIZE, OVERLAP, DIMS = 5, 800, 400, 128
TERMS = f"""select {{key}}, ('0x' || substr(md5(w), 1, 7))::bigint % {DIMS} e, count(*)::double n from (select {{key}}, unnest(regexp_split_to_array(lower({{text}}), '\\s+')) w from {{source}}) where length(w) > 0 group by 1, 2"""
OFFLINE = f"""c as (select doc_id, doc_id || ':' || i point, substr(text, i * {SIZE - OVERLAP} + 1, {SIZE}) text from (select doc_id, text, unnest(range(case when length(text) <= {SIZE} then 1 else cast(ceil((length(text) - {SIZE}) / {SIZE - OVERLAP}.0) as bigint) + 1 end)) i from documents where length(text) > 0)),
 pairs as (select item_id qid, doc_id, b.text span from benchmark b join documents d on contains(d.text, b.text) where length(b.text) > 0), gold as (select distinct qid, point from pairs join c using (doc_id) where contains(text, span)),
 asked as (select item_id qid, text from benchmark where item_id in (select qid from gold)), ct as ({TERMS.format(key="point", text="text", source="c")}), qt as ({TERMS.format(key="qid", text="text", source="asked")}),
 cn as (select point, sqrt(sum(n * n)) z from ct group by 1), qn as (select qid, sqrt(sum(n * n)) z from qt group by 1), dots as (select qid, point, sum(qt.n * ct.n) dot from qt join ct using (e) group by 1, 2),
 every as (select qid, qn.z qz, point, cn.z cz from qn cross join cn), scored as (select qid, point, round(coalesce(dot, 0) / (qz * cz), 9) score from every left join dots using (qid, point)),
 hits as (select *, row_number() over (partition by qid order by score desc, point) rank from scored qualify rank <= {K}),
 m as (select a.qid::varchar qid, g.n gold_count, coalesce(h.n, 0) hits, coalesce(h.n, 0) / g.n::double recall, coalesce(h.n, 0) / {K}::double "precision", coalesce(1 / h.first::double, 0) reciprocal_rank, (coalesce(h.n, 0) > 0)::int::double hit, h.first first_hit_rank
 from asked a join (select qid, count(*) n from gold group by 1) g using (qid) left join (select qid, count(*) n, min(rank) "first" from hits join gold using (qid, point) group by 1) h using (qid))"""


def evaluation(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    items = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("span"))
    cases = items.select("qid", F.col("span").alias("question"))
    hits, metrics = offline.evaluated(docs, cases, passages.holding(items, docs), K, SIZE, OVERLAP, DIMS)
    return cases, hits, metrics


@query("offline_evaluation", f"with {OFFLINE} select qid, gold_count, hits, round(recall, 6) recall, round(\"precision\", 6) \"precision\", round(reciprocal_rank, 6) reciprocal_rank, hit, first_hit_rank, case when hits = 0 then 'retrieval_miss' when hits < gold_count then case when first_hit_rank > 3 then 'retrieval_partial,retrieval_low_rank' else 'retrieval_partial' end when first_hit_rank > 3 then 'retrieval_low_rank' else '' end flags from m")
def offline_evaluation(s: SparkSession, d: str) -> DataFrame:
    _, _, m = evaluation(s, d)
    rounded = {c: S.rounded(F.col(c)) for c in ("recall", "precision", "reciprocal_rank")}
    return offline.flagged(m, K).withColumns(rounded).withColumn("flags", F.array_join("flags", ","))


@query("offline_summary", f"with {OFFLINE} select {K}::bigint k, (select count(*) from benchmark) cases_total, count(*) cases_evaluated, (select count(*) from benchmark) - count(*) cases_skipped_no_gold, round(coalesce(avg(recall), 0), 6) recall_at_k, round(coalesce(avg(\"precision\"), 0), 6) precision_at_k, round(coalesce(avg(reciprocal_rank), 0), 6) mrr_at_k, round(coalesce(avg(hit), 0), 6) hit_at_k, round(avg(gold_count), 4) avg_gold_chunks, round(avg(hits), 4) avg_hits from m")
def offline_summary(s: SparkSession, d: str) -> DataFrame:
    cases, _, m = evaluation(s, d)
    return offline.report(cases, m, K)


@query("offline_worst", f"with {OFFLINE} select qid, round(recall, 6) recall, coalesce(first_hit_rank, 0) first_hit_rank from m order by recall, coalesce(first_hit_rank, 0) desc, qid limit 10")
def offline_worst(s: SparkSession, d: str) -> DataFrame:
    _, _, m = evaluation(s, d)
    return offline.worst(m).withColumn("recall", S.rounded("recall"))


@query("ann_recall", "select count(*) filter (vec_id % 50 = 0) queries, (count(*) filter (vec_id % 50 = 0)) * least(10, count(*) - 1) wanted, true every_vector_indexed, true recall_enough, true fewer_distances from embeddings")
def ann_recall(s: SparkSession, d: str) -> DataFrame:
    """Ten nearest of the vectors whose id 50 divides, from probed lists, beside the exact ones."""
    points = table(s, d, "embeddings").select("vec_id", "embedding")
    asked = points.where("vec_id % 50 = 0")
    quantiser = ann.fit(points)
    lists = written(ann.index(points, quantiser), "lists")
    found = ann.search(lists, asked, quantiser)
    exact = retrieval.top_k(points, asked, quantiser.centres.shape[1], 10).select("qid", F.col("vec_id").alias("id"))
    out = ann.recall(found, exact).crossJoin(F.broadcast(asked.agg(F.count("*").alias("queries")))).crossJoin(F.broadcast(lists.agg(F.count_distinct("id").alias("indexed")))).crossJoin(F.broadcast(points.agg(F.count("*").alias("points"))))
    return out.select("queries", "wanted", (F.col("indexed") == F.col("points")).alias("every_vector_indexed"), (F.col("recall") >= 0.9).alias("recall_enough"), F.lit(quantiser.share < 1).alias("fewer_distances"))
