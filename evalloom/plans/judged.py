"""Queries that generate and judge answers through a cache, by a client whose replies follow from the prompt's length."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators import judging as J
from evalloom.operators.usage import LABELS
from evalloom.sources.tables import table

Q, SQL = {}, {}


def query(name: str, sql: str):
    def add(make):
        Q[name], SQL[name] = make, sql
        return make

    return add


@dataclass
class LengthClient:
    """Replies by the prompt's length n: unavailable at first if 17 divides n, broken at first if 11 does, and always if ``broken`` does."""

    kind: str
    broken: int
    seen: dict = field(default_factory=dict)

    def __call__(self, system: str, user: str) -> J.Reply:
        import json

        n = len(user)
        nth = self.seen[user] = self.seen.get(user, -1) + 1
        if n % 17 == 0 and nth == 0:
            raise J.Unavailable("busy")
        text = ""
        if n % self.broken == 0 or (n % 11 == 0 and nth == (n % 17 == 0)):
            text = {"claims": "sorry {", "rubric": '{"relevance": 9}', "answer": " \n"}[self.kind]
        elif self.kind == "claims":
            text = "Here: " + json.dumps({"claims": [{"text": f"claim {i}", "label": LABELS[(n + i) % 3]} for i in range(1 + n % 4)]}) + " done"
        elif self.kind == "rubric":
            text = f'```json\n{{"relevance": {1 + n % 5}, "helpfulness": {1 + n % 3}, "reason": "{{n}}"}}\n```'
        else:
            text = f" answer of {n} \n"
        return J.Reply(text, n, n % 50)


def broken(kind: str) -> int:
    return {"claims": 13, "rubric": 7, "answer": 5}[kind]


class Judge:
    """Claims or rubric, as the system prompt says."""

    def __init__(self) -> None:
        self.by = {kind: LengthClient(kind, broken(kind)) for kind in ("claims", "rubric")}

    def __call__(self, system: str, user: str) -> J.Reply:
        return self.by[system](system, user)


MODEL = "length"
CLAIMS = J.Prompt("claims", "Q: {question}\nC: {contexts}\nA: {answer}", ("contexts", "question", "answer"))
RUBRIC = J.Prompt("rubric", "Q: {question}\nA: {answer}\nS: {claims_summary}", ("question", "answer"))
ANSWER = J.Prompt("answer", "C: {contexts}\nQ: {question}")

# A turn of a conversation is a case whose own text is its only hit; some were judged before, some of these entries are damaged.
CASES_SQL = f"""cases as (select conv_id * 1000 + turn case_id, role question, case when conv_id % 29 = 0 then ' ' else text end answer, regexp_replace(text, '^\\s+|\\s+$', '', 'g') t from conversations where text is not null),
 asked as (select *, case when t = '' or length(t) + 8 > 3000 then '（无检索结果）' else '[1] (d)' || chr(10) || t end contexts from cases where trim(answer, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
 c0 as (select *, 11 + length(question) + length(contexts) + length(answer) n, length(answer) % 5 = 0 and length(answer) % 10 <> 0 known, min(case_id) over (partition by question, answer, contexts) asker from asked),
 c1 as (select *, not known and asker = case_id asks, not known and n % 13 = 0 failed from c0),
 c2 as (select *, case when known then ['supported'] else list_transform(range(1 + n % 4), lambda i: ['supported', 'unsupported', 'irrelevant'][((n + i) % 3 + 1)::int]) end labels from c1),
 c3 as (select *, '共 ' || len(labels) || ' 条断言：supported ' || len(list_filter(labels, lambda x: x = 'supported')) || ' / unsupported ' || len(list_filter(labels, lambda x: x = 'unsupported')) || ' / irrelevant ' || len(list_filter(labels, lambda x: x = 'irrelevant')) summary from c2),
 c4 as (select *, 11 + length(question) + length(answer) + length(summary) n2 from c3),
 r0 as (select *, min(case_id) filter (not failed) over (partition by question, answer, summary) = case_id and not failed asks2 from c4),
 judged as (select case_id, case when failed then 'no claims' end error, case when not failed then array_to_string(labels, ',') end labels, case when not failed and n2 % 7 <> 0 then 1 + n2 % 5 end relevance, case when not failed and n2 % 7 <> 0 then 1 + n2 % 3 end helpfulness,
  case when failed then null when n2 % 7 = 0 then 'bad relevance' else '' end rubric_skipped_reason, case when failed then null when asks then (n % 17 = 0)::int + case when n % 11 = 0 then 2 else 1 end else 0 end claims_calls, case when not failed then (not asks)::int end claims_cache_hits,
  case when failed then null when asks2 then (n2 % 17 = 0)::int + case when n2 % 7 = 0 then 3 when n2 % 11 = 0 then 2 else 1 end else 0 end rubric_calls, case when not failed then (not asks2 and n2 % 7 <> 0)::int end rubric_cache_hits,
  case when not failed then case when asks and n % 11 = 0 then 1 else 0 end + case when not asks2 then 0 when n2 % 7 = 0 then 2 when n2 % 11 = 0 then 1 else 0 end end protocol_retries,
  case when not failed then case when not asks then 0 when n % 11 = 0 then 2 * n else n end + case when not asks2 then 0 when n2 % 7 = 0 then 3 * n2 when n2 % 11 = 0 then 2 * n2 else n2 end end prompt_tokens,
  case when not failed then case when asks then 0 when known then 7 when n % 11 = 0 then 2 * n else n end + case when asks2 or n2 % 7 = 0 then 0 when n2 % 11 = 0 then 2 * n2 else n2 end end saved from r0
  union all select case_id, 'blank answer', null, null, null, null, null, null, null, null, null, null, null from cases where case_id not in (select case_id from asked))"""


def cases(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations").where("text is not null")
    hit = F.struct(F.lit("d").alias("doc_id"), F.col("text"))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.col("role").alias("question"), F.when(F.col("conv_id") % 29 == 0, " ").otherwise(F.col("text")).alias("answer"), F.array(hit).alias("hits"), F.lit(None).cast("string").alias("reference_answer"))


def cache(s: SparkSession, d: str) -> DataFrame:
    """Entries of the cases whose answers' lengths 5 divides; those of an even length are damaged."""
    n = F.length("answer")
    entry = F.when(n % 10 == 0, '{"claims": 3}').otherwise('{"claims": [{"id": 1, "text": "known", "label": "supported"}]}')
    asked = J.claims_requests(cases(s, d), MODEL, CLAIMS).where(n % 5 == 0)
    return asked.select("cache_key", F.lit("claims").alias("stage"), entry.alias("response"), F.lit(7).cast("long").alias("prompt_tokens"), F.lit(3).cast("long").alias("completion_tokens"), F.lit(0).cast("long").alias("hits")).distinct()


def judged(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return J.judge_cases(cases(s, d), cache(s, d), Judge(), MODEL, CLAIMS, RUBRIC, delays=(0.0,))


@query("judged_through_cache", f"with {CASES_SQL} select * from judged")
def judged_through_cache(s: SparkSession, d: str) -> DataFrame:
    out, _ = judged(s, d)
    m = F.col("judge.meta")
    kept = [m[c].alias(c) for c in ("rubric_skipped_reason", "claims_calls", "claims_cache_hits", "rubric_calls", "rubric_cache_hits", "protocol_retries", "prompt_tokens")]
    return out.select("case_id", "error", F.array_join("judge.claims.label", ",").alias("labels"), F.col("judge.rubric.relevance").cast("long").alias("relevance"), F.col("judge.rubric.helpfulness").cast("long").alias("helpfulness"), *kept, m["cache_saved_prompt_tokens"].alias("saved"))


@query("judge_cache_after", f"""with {CASES_SQL}, keys as (select distinct question, answer, contexts from asked where length(answer) % 5 = 0),
 new as (select distinct question, answer, contexts from c1 where not known and not failed and length(answer) % 10 <> 0), rubrics as (select distinct question, answer, summary from r0 where not failed and n2 % 7 <> 0)
 select 'claims' stage, (select count(*) from keys) + (select count(*) from new) entries, (select sum(claims_cache_hits) from judged)::bigint hits union all select 'rubric', (select count(*) from rubrics), (select sum(rubric_cache_hits) from judged)::bigint""")
def judge_cache_after(s: SparkSession, d: str) -> DataFrame:
    before = cache(s, d)
    out, fresh = judged(s, d)
    after = J.cache_after(before, out, fresh)
    return after.groupBy("stage").agg(F.count("*").alias("entries"), F.sum("hits").alias("hits"))


@query("answers_generated", """with p as (select item_id, 7 + length(text) + case when length(t) + 5 + length(item_id::varchar) > 3000 or t = '' then length('（无检索结果）') else length('[1] (' || item_id || ')' || chr(10) || t) end n, text, t from (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') t from benchmark))
 select item_id case_id, case when n % 5 <> 0 then 'answer of ' || n end answer, case when n % 5 = 0 then 'blank answer' end error, case when n % 5 <> 0 then (n % 17 = 0)::int + case when n % 11 = 0 then 2 else 1 end end calls, case when n % 5 <> 0 then case when n % 11 = 0 then 2 * n else n end end prompt_tokens from p""")
def answers_generated(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("question"), F.array(F.struct(F.col("item_id").cast("string").alias("doc_id"), "text")).alias("hits"))
    out = J.generate_answers(items, LengthClient("answer", broken("answer")), ANSWER, MODEL, delays=(0.0,))
    return out.select("case_id", "answer", "error", "generation.calls", "generation.prompt_tokens")
