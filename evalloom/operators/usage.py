"""What a run used and found: generation and judge usage, rates, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.scoring import rounded

LABELS = ("supported", "unsupported", "irrelevant")
#: Counters of a judgement's meta that are summed up, by the names of the sums.
META_SUMS = {"judge_claims_calls": ("claims_calls",), "judge_rubric_calls": ("rubric_calls",), "judge_cache_hits": ("claims_cache_hits", "rubric_cache_hits"), "judge_prompt_tokens": ("prompt_tokens",), "judge_completion_tokens": ("completion_tokens",), "judge_cache_saved_prompt_tokens": ("cache_saved_prompt_tokens",), "judge_cache_saved_completion_tokens": ("cache_saved_completion_tokens",)}


def generation_usage(results: DataFrame) -> DataFrame:
    """One row from ``answer`` and a struct ``generation``: answers that aren't empty, and tokens, 0 where none are known."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c.split(".")[1])
    return results.agg(F.count_if(F.coalesce(F.col("answer"), F.lit("")) != "").alias("answers_generated"), total("generation.prompt_tokens"), total("generation.completion_tokens"))


def label_counts(claims: Column) -> dict[str, Column]:
    """How many claims of a case there are, and of each label, without a row for each claim."""
    of = lambda label: F.size(F.filter(claims, lambda c: c["label"] == label))
    n = {"claims": F.size(claims), **{label: of(label) for label in LABELS}}
    return {k: F.when(claims.isNull(), 0).otherwise(v).cast("long") for k, v in n.items()}


def judge_usage(results: DataFrame) -> DataFrame:
    """One row of fifteen measures from a struct ``judge`` of claims, rubric and meta (null without a judgement).

    ``rubric_cases`` counts judgements that have the key, ``rubric_scored_cases`` those whose rubric isn't null."""
    counts = label_counts(F.col("judge.claims"))
    per_case = results.select("judge", *(v.alias(k) for k, v in counts.items()))
    total = lambda *c: sum((F.coalesce(F.sum(x), F.lit(0)) for x in c[1:]), F.coalesce(F.sum(c[0]), F.lit(0)))
    mean = lambda c: F.coalesce(rounded(F.avg(c), 4), F.lit(0.0))
    return per_case.agg(
        total("claims").alias("claims_total"),
        *(total(label).alias(f"claims_{label}") for label in LABELS),
        F.count_if(F.col("claims") > 0).alias("cases_judged"),
        F.count_if(F.col("judge").isNotNull()).alias("rubric_cases"),
        F.count_if(F.col("judge.rubric").isNotNull()).alias("rubric_scored_cases"),
        *(total(*(f"judge.meta.{c}" for c in columns)).alias(name) for name, columns in META_SUMS.items()),
        mean("judge.rubric.relevance").alias("relevance_avg"),
        mean("judge.rubric.helpfulness").alias("helpfulness_avg"),
    )


def run_rates(usage: DataFrame) -> DataFrame:
    """``usage`` with the three rates and claims per answer: null without claims, all null if nothing was judged."""
    n, judged = F.col("claims_total"), (F.col("cases_judged") > 0) | (F.col("judge_claims_calls") > 0)
    some = judged & (n > 0)
    out = usage
    for name, label in (("claim_support_rate", "supported"), ("hallucination_rate", "unsupported"), ("irrelevant_rate", "irrelevant")):
        out = out.withColumn(name, F.when(some, rounded(F.try_divide(F.col(f"claims_{label}"), n))))
    out = out.withColumn("avg_claims_per_answer", F.when(some, rounded(F.try_divide(n, F.col("cases_judged")), 4)))
    return out.withColumn("judged", judged).withColumn("rates_consistent", rates_consistent(n, *(F.col(c) for c in ("claim_support_rate", "hallucination_rate", "irrelevant_rate"))))


def rates_consistent(claims: Column, *rates: Column, tolerance: float = 1e-5) -> Column:
    """Whether the rates add up to 1; null without claims."""
    total = sum((F.coalesce(r, F.lit(0.0)) for r in rates[1:]), F.coalesce(rates[0], F.lit(0.0)))
    return F.when(claims > 0, F.abs(total - 1) <= tolerance)


def merged_usage(parts: DataFrame, counters: list[str], by: list[str] | None = None) -> DataFrame:
    """Sums of counters, element by element."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]
    return parts.groupBy(*by).agg(*sums) if by else parts.agg(*sums)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def rubric_score(value: Column) -> Column:
    """A score of 1 to 5 from a mean: rounded half up, null for none and for what isn't above 0."""
    return F.when(value > 0, F.least(F.floor(value + 0.5), F.lit(5)).cast("int"))


def has_key(document: Column, key: str) -> Column:
    """Whether a JSON object has a key, with a value or with null; false for anything else than an object."""
    return F.coalesce(F.array_contains(F.json_object_keys(document), key), F.lit(False))


def has_value(document: Column, key: str) -> Column:
    """Whether a JSON object has a value other than null under a key."""
    return F.coalesce(F.get_json_object(document, f"$.{key}") != "null", F.lit(False)) & has_key(document, key)


def rubric_counts(results: DataFrame, judge: str = "judge") -> DataFrame:
    """One row from judgements as JSON: those with a rubric key, and those whose rubric isn't null."""
    return results.agg(F.count_if(has_key(F.col(judge), "rubric")).alias("rubric_cases"), F.count_if(has_value(F.col(judge), "rubric")).alias("rubric_scored_cases"))
