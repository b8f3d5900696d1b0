"""Answers made and judged by a model behind a callable: a cache first, calls only for what it lacks, retries, and new entries for the cache.

A client takes a prompt (system, user) and gives a ``Reply``; it raises ``Unavailable`` where calling again may help.
It travels to the tasks, so it must pickle. Calls are made once for each cache key, by the case with the smallest id;
the others that share the key are hits, as they would be one after another."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.formats import claims_summary
from evalloom.operators import prompting as P
from evalloom.operators.passages import first_object, stripped
from evalloom.operators.usage import LABELS, label_counts
from evalloom.sources.scratch import written

#: Seconds to wait after the first, second, ... call without an answer.
DELAYS = (0.5, 1.5)
#: Calls of a task at one time.
AT_ONCE = 4
PROTOCOL = "1"
# Fixed value: the text for a missing reference answer.
NO_REFERENCE = "（未提供）"

CLAIMS = "array<struct<id:int,text:string,label:string,evidence:string,reason:string>>"
RUBRIC = "struct<relevance:int,helpfulness:int,reason:string>"


@dataclass(frozen=True)
class Reply:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


class Unavailable(RuntimeError):
    """No answer now; the same call may succeed later."""


class ProtocolError(ValueError):
    """An answer that isn't what was asked for."""


@dataclass(frozen=True)
class Prompt:
    """A checked template; ``digest`` names it in cache keys."""

    system: str
    user: str
    required: tuple[str, ...] = ("contexts", "question")

    def __post_init__(self) -> None:
        P.checked_placeholders(self.user, self.required)

    @property
    def digest(self) -> str:
        import hashlib

        text = json.dumps({"system": self.system.strip(), "user": self.user.strip()}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()[:16]


Client = Callable[[str, str], Reply]
#: What is kept of an answer, as JSON, and how many claims were too many.
Accept = Callable[[str], tuple[str, int]]


def read_claims(most: int) -> Accept:
    """Answers that are an object with ``claims``: each with text and a known label, at most ``most``, numbered."""

    def accept(answer: str) -> tuple[str, int]:
        found = first_object(answer)
        listed = json.loads(found).get("claims") if found else None
        if not isinstance(listed, list):
            raise ProtocolError("no claims")
        out = []
        for n, c in enumerate(listed, 1):
            text, label = (c.get("text"), c.get("label")) if isinstance(c, dict) else (None, None)
            if not isinstance(text, str) or not text.strip() or label not in LABELS:
                raise ProtocolError(f"bad claim {n}")
            out.append({"id": n, "text": text.strip(), "label": label, **{k: c[k] for k in ("evidence", "reason") if isinstance(c.get(k), str)}})
        return json.dumps({"claims": out[:most]}, ensure_ascii=False, sort_keys=True), max(0, len(out) - most)

    return accept


def read_rubric(answer: str) -> tuple[str, int]:
    """Answers that are an object with relevance and helpfulness, whole numbers of 1 to 5."""
    found = first_object(answer)
    row = json.loads(found) if found else {}
    for name in ("relevance", "helpfulness"):
        value = row.get(name)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or not 1 <= value <= 5:
            raise ProtocolError(f"bad {name}")
    kept = {"relevance": int(row["relevance"]), "helpfulness": int(row["helpfulness"])}
    return json.dumps(kept | {"reason": str(row.get("reason") or "")}, ensure_ascii=False, sort_keys=True), 0


def read_answer(answer: str) -> tuple[str, int]:
    """Any answer that isn't blank."""
    if not (answer or "").strip():
        raise ProtocolError("blank answer")
    return answer.strip(), 0


def ask(client: Client, accept: Accept, system: str, user: str, attempts: int, delays: tuple[float, ...]) -> tuple:
    """(response, truncated, calls, protocol_retries, prompt_tokens, completion_tokens, error) of one request."""
    calls = spent = made = retries = 0
    error = ""
    for attempt in range(attempts):
        reply = None
        for wait in (*delays, None):
            calls += 1
            try:
                reply = client(system, user)
                break
            except Unavailable as e:
                error = f"unavailable: {e}"
                if wait is not None:
                    time.sleep(wait)
        if reply is None:
            break
        spent, made = spent + reply.prompt_tokens, made + reply.completion_tokens
        try:
            response, truncated = accept(reply.text)
            return response, truncated, calls, retries, spent, made, None
        except ProtocolError as e:
            error = str(e)
            retries += attempt + 1 < attempts
    return None, 0, calls, retries, spent, made, error


REPLIES = "cache_key string, asker long, response string, truncated int, calls int, protocol_retries int, prompt_tokens long, completion_tokens long, error string"


def completed(requests: DataFrame, client: Client, accept: Accept, system: str, attempts: int = 3, delays: tuple[float, ...] = DELAYS, at_once: int = AT_ONCE) -> DataFrame:
    """Calls for each of ``requests`` (cache_key, asker, prompt), as a table, so that no call is repeated by a later read."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                keys, askers, prompts = batch.columns
                rows = list(pool.map(lambda p: ask(client, accept, system, p, attempts, delays), prompts.to_pylist()))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([keys, askers, *columns], names=[f.split()[0] for f in REPLIES.split(", ")])

    return written(requests.select("cache_key", "asker", "prompt").mapInArrow(call, REPLIES), "replies")


def through_cache(requests: DataFrame, cache: DataFrame, client: Client, accept: Accept, valid: Column, system: str, attempts: int = 3, delays: tuple[float, ...] = DELAYS, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """``requests`` (case_id, cache_key, prompt, ...) with their responses, and the new entries of the cache.

    ``cache`` has cache_key, response and the tokens it took; an entry that isn't ``valid`` any more counts as none.
    Results have response, hit, calls, protocol_retries, truncated, the tokens spent and saved, and error."""
    known = cache.where(valid).groupBy("cache_key").agg(F.min(F.struct("response", "prompt_tokens", "completion_tokens")).alias("known"))
    met = requests.join(known, "cache_key", "left")
    lacking = met.where("known is null").groupBy("cache_key").agg(F.min("case_id").alias("asker"), F.min_by("prompt", "case_id").alias("prompt"))
    made = completed(lacking, client, accept, system, attempts, delays, at_once)
    reply = F.struct(*[F.col(c) for c in made.columns if c != "cache_key"])
    both = met.join(made.select("cache_key", reply.alias("reply")), "cache_key", "left")
    asked = F.coalesce(F.col("reply.asker") == F.col("case_id"), F.lit(False))
    own = lambda c: F.when(asked, F.col(f"reply.{c}")).otherwise(0).alias(c)
    hit = F.col("known").isNotNull() | (~asked & F.col("reply.error").isNull())
    saved = lambda c: F.when(hit, F.coalesce(f"known.{c}", f"reply.{c}")).otherwise(0).alias(f"saved_{c}")
    results = both.select(*requests.columns, F.coalesce("known.response", "reply.response").alias("response"), hit.alias("hit"), *map(own, ("calls", "protocol_retries", "truncated", "prompt_tokens", "completion_tokens")), *map(saved, ("prompt_tokens", "completion_tokens")), F.col("reply.error").alias("error"))
    return results, made.where("error is null").select("cache_key", "response", "prompt_tokens", "completion_tokens")


def generate_answers(cases: DataFrame, client: Client, prompt: Prompt, model: str, budget: int = 3000, attempts: int = 3, delays: tuple[float, ...] = DELAYS, at_once: int = AT_ONCE) -> DataFrame:
    """``cases`` (case_id, question, hits) with an ``answer``, what it was made of (``generation``), and ``error``.

    A blank answer is asked for again, like one that doesn't come; after the last attempt it is an error."""
    packed = cases.withColumn("bundle", P.context_bundle(F.col("hits"), budget))
    asked = packed.withColumn("prompt", P.rendered(prompt.user, required=prompt.required, contexts=F.col("bundle.text"), question=F.col("question")))
    made = completed(asked.select(F.col("case_id").cast("string").alias("cache_key"), F.col("case_id").alias("asker"), "prompt"), client, read_answer, prompt.system, attempts, delays, at_once)
    both = asked.join(made.withColumnRenamed("asker", "case_id"), "case_id")
    generation = F.struct(F.lit(model).alias("model"), F.lit(prompt.digest).alias("prompt_hash"), F.col("bundle.chunks").alias("context_chunks"), F.col("bundle.chars").alias("context_chars"), F.col("bundle.dropped").alias("dropped_contexts"), "prompt_tokens", "completion_tokens", "calls")
    return both.select(*cases.columns, F.col("response").alias("answer"), F.when(F.col("error").isNull(), generation).alias("generation"), "error")


def is_blank(column: str) -> Column:
    return stripped(F.coalesce(column, F.lit(""))) == ""


def claims_requests(cases: DataFrame, model: str, prompt: Prompt, budget: int = 3000, most_claims: int = 12) -> DataFrame:
    """``cases`` that have an answer, with the packed contexts, the prompt and the cache key of their claims."""
    text = lambda c: P.json_text(F.col(c))
    packed = cases.where(~is_blank("answer")).withColumn("bundle", P.context_bundle(F.col("hits"), budget)).withColumn("contexts", F.col("bundle.text"))
    payload = P.canonical_json(_protocol=P.json_text(F.lit(PROTOCOL)), answer=text("answer"), contexts=text("contexts"), max_claims=F.lit(str(most_claims)), question=text("question"))
    keyed = packed.withColumn("cache_key", P.cache_key("claims", F.lit(prompt.digest), F.lit(model), payload))
    return keyed.withColumn("prompt", P.rendered(prompt.user, required=prompt.required, contexts=F.col("contexts"), question=F.col("question"), answer=F.col("answer")))


def judge_cases(cases: DataFrame, cache: DataFrame, client: Client, model: str, claims_prompt: Prompt, rubric_prompt: Prompt | None = None, budget: int = 3000, most_claims: int = 12, attempts: int = 3, delays: tuple[float, ...] = DELAYS, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(case_id, judge, error) of ``cases`` (case_id, question, answer, hits, reference_answer), and new cache entries.

    Claims come first; without them a case isn't judged (``error``, to be tried again). The rubric only adds to them:
    if it fails, the judgement stays, with the reason in its ``meta``. The most claims are part of the cache key."""
    text = lambda c: P.json_text(F.col(c))
    asked = claims_requests(cases, model, claims_prompt, budget, most_claims)
    listed = F.from_json("response", f"claims {CLAIMS}")["claims"]
    whole = listed.isNotNull() & ~F.exists(listed, lambda c: c["text"].isNull() | ~F.coalesce(c["label"].isin(*LABELS), F.lit(False)))
    stage = lambda entries, name, prompt: entries.select("*", F.lit(name).alias("stage"), F.lit(model).alias("model"), F.lit(prompt.digest).alias("prompt_hash"))
    first, fresh = through_cache(asked, cache, client, read_claims(most_claims), F.coalesce(whole, F.lit(False)), claims_prompt.system, attempts, delays, at_once)
    fresh = stage(fresh, "claims", claims_prompt)
    used = ("hit", "calls", "protocol_retries", "prompt_tokens", "completion_tokens", "saved_prompt_tokens", "saved_completion_tokens")
    first = first.select("case_id", "question", "answer", "reference_answer", "bundle", listed.alias("claims"), F.struct(*used, "truncated").alias("c"), "error", F.col("cache_key").alias("claims_key"))
    if rubric_prompt:
        named = "{claims_summary}" in rubric_prompt.user
        ok = first.where("error is null").withColumn("claims_summary", claims_summary(label_counts(F.col("claims")))).withColumn("given", F.coalesce("reference_answer", F.lit("")))
        parts = {"_protocol": P.json_text(F.lit(PROTOCOL)), "question": text("question"), "answer": text("answer"), "reference_answer": text("given")}
        values = {"question": F.col("question"), "answer": F.col("answer"), "reference_answer": F.when(F.col("given") == "", NO_REFERENCE).otherwise(F.col("given"))}
        if named:
            parts["claims_summary"], values["claims_summary"] = text("claims_summary"), F.col("claims_summary")
        values = {k: v for k, v in values.items() if "{" + k + "}" in rubric_prompt.user}
        ok = ok.withColumn("cache_key", P.cache_key("rubric", F.lit(rubric_prompt.digest), F.lit(model), P.canonical_json(**parts))).withColumn("prompt", P.rendered(rubric_prompt.user, required=rubric_prompt.required, **values))
        row = F.from_json("response", "relevance int, helpfulness int, reason string")
        good = F.coalesce(row["relevance"].between(1, 5) & row["helpfulness"].between(1, 5), F.lit(False))
        second, more = through_cache(ok.select("case_id", "cache_key", "prompt"), cache, client, read_rubric, good, rubric_prompt.system, attempts, delays, at_once)
        fresh = fresh.unionByName(stage(more, "rubric", rubric_prompt))
        second = second.select("case_id", F.when(F.col("response").isNotNull(), row).alias("rubric"), F.struct(*used).alias("r"), F.coalesce("error", F.lit("")).alias("rubric_skipped_reason"), F.col("cache_key").alias("rubric_key"))
        first = first.join(second, "case_id", "left")
    else:
        nothing = F.struct(F.lit(False).alias("hit"), *(F.lit(0).alias(c) for c in used[1:]))
        first = first.select("*", F.lit(None).cast(RUBRIC).alias("rubric"), nothing.alias("r"), F.lit("not asked for").alias("rubric_skipped_reason"), F.lit(None).cast("string").alias("rubric_key"))
    n = lambda c: F.coalesce(c, F.lit(0))
    added = lambda f: (n(F.col(f"c.{f}")) + n(F.col(f"r.{f}"))).alias(f)
    meta = F.struct(
        F.lit(model).alias("judge_model"), F.lit(claims_prompt.digest).alias("claims_prompt_hash"), F.lit(rubric_prompt.digest if rubric_prompt else "").alias("rubric_prompt_hash"), F.lit(budget).alias("max_context_chars"), F.lit(most_claims).alias("max_claims"), F.lit(PROTOCOL).alias("protocol_version"),
        F.col("bundle.chunks").alias("context_chunks"), F.col("bundle.chars").alias("context_chars"), F.col("bundle.dropped").alias("dropped_contexts"),
        n(F.col("c.calls")).alias("claims_calls"), n(F.col("c.hit").cast("int")).alias("claims_cache_hits"), n(F.col("r.calls")).alias("rubric_calls"), n(F.col("r.hit").cast("int")).alias("rubric_cache_hits"),
        added("protocol_retries"), n(F.col("c.truncated")).alias("truncated_claims"), added("prompt_tokens"), added("completion_tokens"), added("saved_prompt_tokens").alias("cache_saved_prompt_tokens"), added("saved_completion_tokens").alias("cache_saved_completion_tokens"),
        F.col("rubric").isNotNull().alias("rubric_enabled"), F.coalesce("rubric_skipped_reason", F.lit("")).alias("rubric_skipped_reason"),
    )
    judge = F.when(F.col("error").isNull(), F.struct("claims", "rubric", meta.alias("meta")))
    keys = F.filter(F.array(F.when(F.col("c.hit"), F.col("claims_key")), F.when(F.col("r.hit"), F.col("rubric_key"))), lambda k: k.isNotNull())
    out = first.select("case_id", judge.alias("judge"), "error", keys.alias("hit_keys"))
    blank = cases.where(is_blank("answer")).select("case_id")
    return out.unionByName(blank.select("case_id", F.lit("blank answer").alias("error")), allowMissingColumns=True), fresh


def cache_after(cache: DataFrame, judged: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with its entries' hits counted, and new entries for keys it doesn't have: the first writer of a key wins."""
    hits = judged.select(F.explode("hit_keys").alias("cache_key")).groupBy("cache_key").agg(F.count("*").alias("more"))
    new = fresh.join(cache, "cache_key", "left_anti").withColumn("hits", F.lit(0).cast("long")).dropDuplicates(["cache_key"])
    all_ = cache.unionByName(new, allowMissingColumns=True).join(hits, "cache_key", "left")
    return all_.withColumn("hits", F.coalesce("hits", F.lit(0)) + F.coalesce("more", F.lit(0))).drop("more")
