"""The same results in SQL that another engine runs."""

from __future__ import annotations

STATES = "['open','fixed','verified','wontfix']"
REASON = """case when len(flags) = 0 then '' when flags[1] in ('no_gold','anchor_incomplete') then 'dataset'
 when flags[1] like 'retrieval%' then 'retrieval' when flags[1] = 'hallucination' then 'hallucination' else 'generation' end"""
SCORED = """scored as (select l.doc_id, case when l.doc_id % 17 <> 0 then toxic = 1 end human_bad, n_chars % 4 = 0 judge_bad,
 1 + n_chars % 5 judge, 1 + (n_chars + quality + toxic) % 5 human, case when l.doc_id % 2 = 0 then 'ann' else 'bo' end annotator, l.doc_id // 2 pair
 from labels l join documents d on l.doc_id = d.doc_id)"""
ITEMS = """items as (select o_custkey % 50 job_id, o_orderkey case_id, case when o_orderstatus = 'O' then 'pending' when o_orderstatus = 'F' then 'succeeded'
 when o_orderkey % 2 = 0 then 'failed' else 'running' end status, o_orderkey % 4 retry_count from orders)"""
CHUNKS = """(select doc_id, i as idx, i * {step} as s, text from (select doc_id, text, unnest(range(case when length(text) <= 500 then 1
 else cast(ceil((length(text) - 500) / {step}.0) as bigint) + 1 end)) i from documents where length(text) > 0))"""


def ranked(name: str, dims: int, k: int) -> str:
    return f"""{name} as (select * from (select q.vec_id qid, p.vec_id, round(list_cosine_similarity(q.embedding[1:{dims}]::double[], p.embedding[1:{dims}]::double[]), 9) score,
 row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding[1:{dims}]::double[], p.embedding[1:{dims}]::double[]), 9) desc, p.vec_id) rank
 from embeddings q join embeddings p on q.vec_id <> p.vec_id where q.vec_id % 10 = 0) where rank <= {k})"""


CASES = "cases as (select vec_id qid, label category, (vec_id // 10) % 3 difficulty from embeddings where vec_id % 10 = 0)"
GOLD = ranked("deep", 64, 3) + ", gold as (select qid, vec_id from deep where rank <= 1 + (qid // 10) % 3 and qid % 70 <> 0), " + CASES


def metric(name: str, source: str, k: int) -> str:
    return f"""{name} as (select c.qid, coalesce(g.n, 0) gold_count, case when g.n is not null then coalesce(h.n, 0) end hits, case when g.n is not null then coalesce(h.n, 0) / g.n::double end recall,
 case when g.n is not null then coalesce(h.n, 0) / {k}::double end "precision", case when g.n is not null then coalesce(1 / h.first::double, 0) end reciprocal_rank,
 case when g.n is not null then (coalesce(h.n, 0) > 0)::int::double end hit, case when g.n is not null then h.first end first_hit_rank from cases c
 left join (select qid, count(*) n from gold group by 1) g on c.qid = g.qid
 left join (select r.qid, count(*) n, min(rank) "first" from {source} r join gold using (qid, vec_id) where rank <= {k} group by 1) h on c.qid = h.qid)"""


def run(name: str, dims: int, k: int) -> str:
    return ranked(f"{name}_r", dims, k) + ", " + metric(name, f"{name}_r", k)


JUDGED = """claims as (select conv_id * 10 qid, length(text) n from conversations), judged as (select qid, count(*) claims,
 count(*) filter (n % 3 = 0) supported, count(*) filter (n % 3 = 1) unsupported, count(*) filter (n % 3 = 2) irrelevant,
 1 + sum(n)::bigint % 5 relevance, 1 + max(n) % 5 helpfulness from claims group by 1)"""


def flagged(name: str, source: str, k: int, judge: bool = False) -> str:
    limit = max(1, (k + 1) // 2)
    join = "left join judged j on m.qid = j.qid" if judge else "left join (select null::bigint claims, null::bigint unsupported, null::bigint irrelevant, null::bigint relevance, null::bigint helpfulness) j on true"
    return f"""{name} as (select m.*, list_filter([case when gold_count = 0 then 'no_gold' end,
 case when hits = 0 and claims > 0 and unsupported = 0 and irrelevant = 0 then 'anchor_incomplete' end, case when hits = 0 then 'retrieval_miss' end,
 case when hits > 0 and hits < gold_count then 'retrieval_partial' end, case when hits > 0 and first_hit_rank > {limit} then 'retrieval_low_rank' end,
 case when unsupported > 0 then 'hallucination' end, case when irrelevant > 0 then 'off_topic' end,
 case when hits > 0 and unsupported = 0 and irrelevant = 0 and least(relevance, helpfulness) <= 3 then 'generation_quality' end,
 case when claims = 0 then 'no_claims' end], lambda x: x is not null) flags from {source} m {join})"""


FLAGS = "with " + GOLD + ", " + run("m", 32, 5) + ", " + JUDGED + ", " + flagged("f", "m", 5, True)
AGGREGATE = """select {k}::bigint k, count(*) cases_total, count(recall) cases_evaluated, count(*) - count(recall) cases_skipped_no_gold, round(coalesce(avg(recall), 0), 6) recall_at_k,
 round(coalesce(avg("precision"), 0), 6) precision_at_k, round(coalesce(avg(reciprocal_rank), 0), 6) mrr_at_k, round(coalesce(avg(hit), 0), 6) hit_at_k,
 round(avg(case when recall is not null then gold_count end), 4) avg_gold_chunks, round(avg(hits), 4) avg_hits from {m}"""
AB = "with " + GOLD + ", " + run("a", 48, 1) + ", " + run("b", 48, 5) + ", " + flagged("l", "a", 1) + ", " + flagged("r", "b", 5) + """, pairs as (select l.qid, category, difficulty,
 coalesce(l.recall, 0) l_recall, coalesce(r.recall, 0) r_recall, coalesce(l."precision", 0) l_precision, coalesce(r."precision", 0) r_precision, coalesce(l.reciprocal_rank, 0) l_rr, coalesce(r.reciprocal_rank, 0) r_rr,
 coalesce(l.hit, 0) l_hit, coalesce(r.hit, 0) r_hit, l.flags lf, r.flags rf from l join r on l.qid = r.qid join cases c on c.qid = l.qid)"""
MOVED = "case when len({l}) > 0 and len({r}) = 0 then 'fixed' when len({l}) = 0 and len({r}) > 0 then 'broke' when list_sort({l}) <> list_sort({r}) then 'changed' else 'stable' end"
STRATUM = """select coalesce({c}::varchar, '未分类') stratum, count(*) cases, round(avg(r_recall - l_recall), 6) mean_delta, count(*) filter (r_recall - l_recall > 2.1e-3) improved,
 count(*) filter (r_recall - l_recall < -2.1e-3) worsened, count(*) filter (len(lf) > 0) flagged_left, count(*) filter (len(rf) > 0) flagged_right, '{c}' "by" from pairs group by 1"""
CLOSURE = AB + f""", ann as (select qid, {STATES}[(qid // 10) % 4 + 1] status from cases), closed as (select a.qid, a.status,
 case when r.flags is null then 'unverifiable' else replace(replace({MOVED.format(l="l.flags", r="r.flags")}, 'fixed', 'improved'), 'broke', 'worsened') end verdict,
 case when l.recall is null or r.recall is null then 'incomparable' when abs(r.recall - l.recall) <= 2.1e-3 then 'same' when r.recall > l.recall then 'better' else 'worse' end evidence
 from ann a join l on a.qid = l.qid left join (select * from r where qid % 130 <> 0) r on a.qid = r.qid), records as (select *, verdict = 'improved' and status = 'fixed' eligible from closed)"""
SHOWN = ' select qid, gold_count, hits, round(recall, 6) recall, round("precision", 6) "precision", round(reciprocal_rank, 6) reciprocal_rank, hit, first_hit_rank from m'
METRIC_ROWS = " union all ".join(f"select '{n}' metric, {c.format('l')} l, {c.format('r')} r from pairs" for n, c in (("recall", "{}_recall"), ("precision", "{}_precision"), ("reciprocal_rank", "{}_rr"), ("hit", "{}_hit")))

SQL = {
    "knn_topk": "with " + ranked("k", 64, 5) + " select qid, vec_id, round(score, 6) score, rank from k",
    "case_metrics_k5": "with " + GOLD + ", " + run("m", 32, 5) + SHOWN,
    "case_metrics_k1": "with " + GOLD + ", " + run("m", 48, 1) + SHOWN,
    "run_aggregate": "with " + GOLD + ", " + run("m", 32, 5) + " " + AGGREGATE.format(k=5, m="m"),
    "k_sensitivity": "with " + GOLD + ", " + ranked("r", 32, 5) + ", " + ", ".join(metric(f"m{k}", "r", k) for k in (1, 3, 5)) + " " + " union all ".join(AGGREGATE.format(k=k, m=f"m{k}") for k in (1, 3, 5)),
    "attribution_flags": FLAGS + f" select qid, array_to_string(flags, ',') flags, {REASON} reason from f",
    "flag_counts": FLAGS + " select flag, count(*) cases from (select unnest(flags) flag from f) group by 1",
    "worst_cases": "with " + GOLD + ", " + run("m", 32, 5) + " select qid, round(recall, 6) recall, round(reciprocal_rank, 6) reciprocal_rank from m where recall is not null order by m.recall, qid limit 10",
    "ab_summary": AB + f""", rows as ({METRIC_ROWS}), s as (select metric, count(*) cases, round(avg(l), 6) mean_left, round(avg(r), 6) mean_right, count(*) filter (r - l > 2.1e-3) improved,
 count(*) filter (r - l < -2.1e-3) worsened, count(*) filter (abs(r - l) <= 2.1e-3) unchanged from rows group by 1) select *, round(mean_right - mean_left, 6) delta, abs(round(mean_right - mean_left, 6)) <= 2.1e-3 below_noise from s""",
    "ab_transitions": AB + f" select {MOVED.format(l='lf', r='rf')} transition, count(*) cases from pairs group by 1",
    "ab_strata": AB + " " + STRATUM.format(c="category") + " union all " + STRATUM.format(c="difficulty"),
    "ab_strata_flag": AB + " select flag, count(*) cases, count(*) filter (list_contains(lf, flag)) flagged_left, count(*) filter (list_contains(rf, flag)) flagged_right from (select lf, rf, unnest(list_distinct(list_concat(lf, rf))) flag from pairs) group by 1",
    "wilcoxon": AB + """, d as (select category, r_recall - l_recall d from pairs where r_recall <> l_recall), t as (select category, abs(d) size, count(*) t, count(*) filter (d > 0) up from d group by 1, 2),
 k as (select *, coalesce(sum(t) over (partition by category order by size rows between unbounded preceding and 1 preceding), 0) + (t + 1) / 2 rank from t),
 o as (select category, sum(t)::bigint n, sum(rank * up) w_plus, sum(t * t * t - t) tied from k group by 1),
 v as (select category, n, w_plus, n * (n + 1) / 4 mean, n * (n + 1) * (2 * n + 1) / 24 - tied / 48 variance from o)
 select *, round(case when variance > 0 then (w_plus - mean + case when w_plus > mean then -0.5 else 0.5 end) / sqrt(variance) end, 6) z from v""",
    "judge_usage": "with " + JUDGED + """ select count(*) cases_judged, sum(claims)::bigint claims, sum(supported)::bigint supported, sum(unsupported)::bigint unsupported, sum(irrelevant)::bigint irrelevant,
 round(sum(unsupported) / sum(claims), 6) hallucination_rate, round(sum(claims) / count(*), 4) avg_claims_per_answer, round(avg(relevance), 4) relevance_avg, round(avg(unsupported / claims), 6) macro_rate from judged""",
    "calibration_binary": "with " + SCORED + """, c as (select count(*) filter (judge_bad and human_bad) tp, count(*) filter (judge_bad and not human_bad) fp, count(*) filter (not judge_bad and not human_bad) tn,
 count(*) filter (not judge_bad and human_bad) fn from scored where human_bad is not null), e as (select *, tp + fp + tn + fn pairs, (tp + tn) / (tp + fp + tn + fn) po,
 ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn)) pe from c), k as (select tp, fp, tn, fn, pairs, round(po, 4) agreement, round(case when pe >= 1 then 0 else (po - pe) / (1 - pe) end, 4) kappa from e)
 select *, case when kappa < 0 then 'poor' when kappa < 0.2 then 'slight' when kappa < 0.4 then 'fair' when kappa < 0.6 then 'moderate' when kappa < 0.8 then 'substantial' else 'almost perfect' end band from k""",
    "calibration_scores": "with " + SCORED + """, s as (select count(*) pairs, count(*) filter (judge = human) exact, count(*) filter (abs(judge - human) <= 1) within_one, round(avg(abs(judge - human)), 4) mae,
 round(avg(judge), 4) judge_mean, round(avg(human), 4) human_mean from scored) select *, round(judge_mean - human_mean, 4) bias from s""",
    "confusion_5x5": "with " + SCORED + " select h, j, count(s.doc_id) n from range(1, 6) a(h) cross join range(1, 6) b(j) left join scored s on s.human = h and s.judge = j group by 1, 2",
    "inter_annotator": "with " + SCORED + " select count(*) pairs, round(avg(abs(a.human - b.human)), 4) mae, round(avg((a.human = b.human)::int), 4) exact_rate from scored a join scored b on a.pair = b.pair and a.annotator = 'ann' and b.annotator = 'bo'",
    "disagreements": "with " + SCORED + " select doc_id, case when human_bad then 'missed' else 'false_alarm' end kind from scored where human_bad <> judge_bad order by 2 desc, 1 limit 50",
    "closure_records": CLOSURE + " select * from records",
    "closure_summary": CLOSURE + " select verdict, count(*) cases, count(*) filter (eligible) eligible from records group by 1",
    "score_noise": "with " + ranked("a", 62, 5) + ", " + ranked("b", 64, 5) + " select count(*) pairs, round(max(abs(a.score - b.score)), 6) max_delta, round(median(abs(a.score - b.score)), 6) median_delta from a join b using (qid, vec_id)",
    "run_consistency": "with " + GOLD + ", " + run("a", 48, 5) + ", " + run("b", 64, 5) + ", " + flagged("fa", "a", 5) + ", " + flagged("fb", "b", 5) + """,
 l as (select qid, list(vec_id order by rank) ids, any_value(flags) flags from a_r join fa using (qid) where qid % 110 <> 0 group by 1), r as (select qid, list(vec_id order by rank) ids, any_value(flags) flags from b_r join fb using (qid) where qid % 130 <> 0 group by 1)
 select coalesce(l.qid, r.qid) qid, case when r.qid is null then 'left' when l.qid is null then 'right' else 'both' end side, list_sort(l.ids) = list_sort(r.ids) same_set, list_sort(l.flags) = list_sort(r.flags) same_flags,
 (select min(i) from range(5) t(i) where l.ids[i + 1] <> r.ids[i + 1]) first_divergence from l full join r on l.qid = r.qid""",
    "job_progress": "with " + ITEMS + " select job_id, " + ", ".join(f"count(*) filter (status = '{s}') {s}" for s in ("pending", "running", "succeeded", "failed")) + ", count(*) total from items group by 1",
    "dead_letters": "with " + ITEMS + " select job_id, count(*) dead from items where status = 'failed' and retry_count + 1 >= 3 group by 1",
    "stale_workers": "select user_id, floor(epoch(max(ts)))::bigint heartbeat from events group by 1 having max(ts) < to_timestamp(1735689600 - 86400 * 2)::timestamp",
    "upsert_last_wins": "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) n from events) where n = 1",
    "cache_first_wins": "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id) n from events) where n = 1",
    "merge_coalesce": "select user_id, arg_max(event_type, event_id) filter (event_id % 3 = 0) verdict, arg_max(value, event_id) filter (event_id % 2 = 0) score from events group by 1",
    "patch_clear": "select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then doc_id % 5 + 1 else quality end quality from labels",
    "annotation_stats": "with " + GOLD + ", " + run("m", 32, 5) + ", " + flagged("f", "m", 5) + f", a as (select {STATES}[(qid // 10) % 4 + 1] status, coalesce(nullif({REASON}, ''), 'unclassified') reason from f) select 'status' kind, status \"value\", count(*) n from a group by 2 union all select 'reason', reason, count(*) from a group by 2",
    "state_machine": f"""select {STATES}[event_id % 4 + 1] old, {STATES}[(event_id // 4) % 4 + 1] "new", count(*) n,
 old = "new" or (old || '>' || "new") in ('open>fixed','open>wontfix','fixed>verified','fixed>open','verified>open','wontfix>open') valid from events group by 1, 2""",
    "fixed_chunks": "select doc_id, idx \"index\", s char_start, least(s + 500, length(text)) char_end, substr(text, s + 1, 500) text from " + CHUNKS.format(step=450),
    "anchor_mapping": "with items as (select item_id qid, text span from benchmark), found as (select qid, doc_id doc, span, text from items join documents on contains(text, span)), c as " + CHUNKS.format(step=100) + """,
 met as (select qid, doc, span, doc || ':' || idx point, case when contains(substr(c.text, s + 1, 500), span) then 2 when contains(lower(regexp_replace(substr(c.text, s + 1, 500), '[\\s[:punct:]]+', '', 'g')), lower(regexp_replace(span, '[\\s[:punct:]]+', '', 'g'))) then 3 end as lvl
 from found join c on c.doc_id = found.doc) select qid, doc, point, lvl::bigint "level" from met qualify lvl = min(lvl) over (partition by qid, doc, span)""",
    "fingerprints": """select doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') config_hash, substr(sha256(trim(text)), 1, 16) prompt_hash from documents""",
    "import_report": """with b as (select item_id + 1 line, case when item_id % 7 = 3 then 'q0' else 'q' || item_id end qid, case when item_id % 11 = 6 then 'invalid JSON' when item_id % 5 = 2 or trim(text) = '' then 'blank question' end error from benchmark),
 f as (select qid, min(line) "first" from b where error is null group by 1) select line, coalesce(error, case when line > "first" then 'duplicate qid' end, 'imported') outcome from b left join f using (qid)""",
    "dataset_case_count": "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) case_count from customer",
    "report_export_rows": """with s as (select doc_id, nullif(trim(regexp_replace(text, '[ \\n]+', ' ', 'g')), '') c from documents)
 select doc_id, case when regexp_matches(c, '[",\\n\\r]') then '"' || replace(c, '"', '""') || '"' else c end cell from s""",
    "hourly_events": "select epoch(date_trunc('hour', ts))::bigint \"start\", event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2",
}

# p by counting all rank sums up to 25 differences, beyond by the normal distribution, whose error function is a series of positive terms
WILCOXON = """rk as (select g, d, (2 * rank() over (partition by g order by abs(d)) + count(*) over (partition by g, abs(d)) - 1)::bigint r2 from nz),
 gr as (select g, count(*) n, list(r2) ranks, coalesce(sum(r2) filter (d > 0), 0)::bigint w2 from rk group by 1), tied as (select g, sum(t * t * t - t) ties from (select g, abs(d) a, count(*) t from nz group by 1, 2) group by 1),
 dp as (select g, 0 i, list_transform(range(n * (n + 1) + 1), lambda x: case when x = 0 then 1.0::double else 0.0::double end) c, ranks, n, w2 from gr where n <= 25
 union all select g, i + 1, list_transform(range(len(c)), lambda x: c[x + 1] + case when x >= ranks[i + 1] then c[x - ranks[i + 1] + 1] else 0.0 end), ranks, n, w2 from dp where i < n),
 exact as (select g, n, w2, round(least(1.0, list_sum(list_filter(c, lambda x, j: abs((j - 1) - n * (n + 1) // 2) >= abs(w2 - n * (n + 1) // 2))) / pow(2, n)), 6) p from dp where i = n),
 z as (select g, n, w2, round((w2 / 2.0 - n * (n + 1) / 4.0 + case when w2 / 2.0 > n * (n + 1) / 4.0 then -0.5 else 0.5 end) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 6) z from gr join tied using (g) where n > 25),
 large as (select g, n, w2, round(1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(150), lambda i: exp(i * ln(4) + lgamma(i + 1) - lgamma(2 * i + 2) + (2 * i + 1) * ln(abs(z) / sqrt(2))))), 6) p from z)"""
SQL |= {
    "wilcoxon_exact": AB.replace("with ", "with recursive ", 1) + ", nz as (select category g, r_recall - l_recall d from pairs where r_recall <> l_recall), " + WILCOXON + """, every as (select * from exact union all select * from large)
 select category, coalesce(n, 0) n, coalesce(w2, 0) / 2.0 w_plus, coalesce(p, 1.0) p from (select distinct category from pairs) left join every on g = category""",
    "context_packing": "with " + ranked("r", 64, 5) + ", c as " + CHUNKS.format(step=450) + """, b as (select qid, row_number() over (partition by qid order by rank, idx) i, length(substr(text, s + 1, 500)) n from r join c on c.doc_id = r.vec_id),
 l as (select qid, list_reduce(list({'used': n, 'ranks': i::varchar} order by i), lambda a, x: case when a.used + x.used + case when a.used > 0 then 2 else 0 end <= 2000 then {'used': a.used + x.used + case when a.used > 0 then 2 else 0 end,
 'ranks': a.ranks || case when a.ranks = '' then '' else ',' end || x.ranks} else a end, {'used': 0::bigint, 'ranks': ''}) p from b group by 1) select qid, p.used used, p.ranks ranks from l""",
    "json_protocol": """with c as (select conv_id, turn, trim(text) t, ['supported', 'unsupported', 'irrelevant', 'odd'][length(text) % 4 + 1] label from conversations)
 select conv_id, turn, case when t <> '' and label <> 'odd' then '[{"id":1,"text":' || to_json(t)::varchar || ',"label":"' || label || '"}]' end claims, case when t = '' or label = 'odd' then 'bad claim' end error from c""",
    "point_ids": """with h as (select doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('corpus1:' || doc_id)) h from documents)
 select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) point_id from h""",
}
