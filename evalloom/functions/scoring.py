"""Expressions: case metrics, attribution flags, transitions, agreement, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Differences up to this are noise.
NOISE_FLOOR = 2.1e-3
# Flags in order of priority.
FLAGS = ("no_gold", "anchor_incomplete", "retrieval_miss", "retrieval_partial", "retrieval_low_rank", "hallucination", "off_topic", "generation_quality", "no_claims")
# The states of an annotation and where each may go.
TRANSITIONS = {"open": ("fixed", "wontfix"), "fixed": ("verified", "open"), "verified": ("open",), "wontfix": ("open",)}
# The family of causes that a first flag suggests.
REASONS = {"no_gold": "dataset", "anchor_incomplete": "dataset", "retrieval_miss": "retrieval", "retrieval_partial": "retrieval", "retrieval_low_rank": "retrieval", "hallucination": "hallucination", "off_topic": "generation", "generation_quality": "generation", "no_claims": "generation"}


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


def low_rank_limit(k: int, ratio: float = 0.5) -> int:
    return max(1, -int(-k * ratio // 1))


def flags(m: Column, judge: Column, k: int | Column, ratio: float = 0.5, quality_line: int = 3) -> Column:
    """The ordered causes of a case from its metrics (null without gold) and its judgement (null if there is none)."""
    limit = F.greatest(F.lit(1), F.ceil(k * F.lit(ratio))) if isinstance(k, Column) else F.lit(low_rank_limit(k, ratio))
    gold = F.coalesce(m["gold_count"], F.lit(0)) > 0
    hit = gold & (m["hits"] > 0)
    judged = judge.isNotNull()
    claims, bad, off = judge["claims"], judge["unsupported"], judge["irrelevant"]
    grounded = judged & (claims > 0) & (bad == 0) & (off == 0)
    poor = judged & hit & (bad == 0) & (off == 0) & judge["relevance"].isNotNull() & judge["helpfulness"].isNotNull() & (F.least(judge["relevance"], judge["helpfulness"]) <= quality_line)
    rules = {
        "no_gold": ~gold,
        "anchor_incomplete": gold & ~hit & grounded,
        "retrieval_miss": gold & ~hit,
        "retrieval_partial": hit & (m["hits"] < m["gold_count"]),
        "retrieval_low_rank": hit & (m["first_hit_rank"] > limit),
        "hallucination": judged & (bad > 0),
        "off_topic": judged & (off > 0),
        "generation_quality": poor,
        "no_claims": judged & (claims == 0),
    }
    return F.filter(F.array(*(F.when(F.coalesce(rules[f], F.lit(False)), F.lit(f)) for f in FLAGS)), lambda x: x.isNotNull())


def transition(left: Column, right: Column) -> Column:
    """What happened to a case's flags from one run to the next."""
    return (
        F.when((F.size(left) > 0) & (F.size(right) == 0), "fixed")
        .when((F.size(left) == 0) & (F.size(right) > 0), "broke")
        .when(F.array_sort(left) != F.array_sort(right), "changed")
        .otherwise("stable")
    )


def reason(flag_list: Column) -> Column:
    """The family that the first flag suggests; empty without flags."""
    first = F.get(flag_list, F.lit(0))
    out = F.lit("unknown")
    for flag, family in REASONS.items():
        out = F.when(first == flag, family).otherwise(out)
    return F.when(F.size(flag_list) == 0, "").otherwise(out)


def valid_transition(old: Column, new: Column) -> Column:
    out = old == new
    for state, targets in TRANSITIONS.items():
        out = out | ((old == state) & new.isin(*targets))
    return out


def kappa(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Cohen's kappa of two binary raters from counts; 0 if chance alone explains all."""
    n = tp + fp + tn + fn
    observed = (tp + tn) / n
    expected = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return F.when(n == 0, 0.0).when(expected >= 1, 0.0).otherwise((observed - expected) / (1 - expected))


def kappa_band(value: Column) -> Column:
    return F.when(value.isNull(), "undefined").when(value < 0, "poor").when(value < 0.2, "slight").when(value < 0.4, "fair").when(value < 0.6, "moderate").when(value < 0.8, "substantial").otherwise("almost perfect")


def csv_cell(text: Column) -> Column:
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def point_id(namespace: str, name: Column) -> Column:
    """A version 5 UUID of a name in a namespace (32 hexadecimal digits)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(h.substr(17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(variant, h.substr(18, 3)), h.substr(21, 12))
