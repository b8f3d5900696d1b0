"""Texts for reports: numbers, changes, summaries; null where there is nothing to say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "—"


def shown(value: Column, text: Column) -> Column:
    """The text of a value that is there; formatting a null wouldn't give null."""
    return F.when(value.isNotNull(), text).otherwise(NONE)


def percent(value: Column, digits: int = 1) -> Column:
    """0.9138 as 91.4%."""
    return shown(value, F.format_string(f"%.{digits}f%%", value * 100))


def score(value: Column, digits: int = 3) -> Column:
    return shown(value, F.format_string(f"%.{digits}f", value))


def points(delta: Column, digits: int = 1) -> Column:
    """0.275 as +27.5pp."""
    return shown(delta, F.concat(F.when(delta > 0, "+").otherwise(""), F.format_string(f"%.{digits}fpp", delta * 100)))


def short_hash(value: Column, n: int = 8) -> Column:
    return F.coalesce(F.nullif(F.substring(value, 1, n), F.lit("")), F.lit(NONE))


def date_time(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm"), F.lit(NONE))


def progress(done: Column, total: Column) -> Column:
    """12/30, with what is done between 0 and the total."""
    safe = F.least(F.greatest(F.coalesce(done, F.lit(0)), F.lit(0)), total)
    return F.when(total > 0, F.format_string("%d/%d", safe.cast("long"), total.cast("long"))).otherwise(NONE)


def progress_percent(done: Column, total: Column) -> Column:
    """0 to 100 with one digit."""
    return F.when(total > 0, F.least(F.greatest(F.round(F.coalesce(done, F.lit(0)) / total * 100, 1), F.lit(0.0)), F.lit(100.0))).otherwise(0.0)


def evidence_value(value: Column) -> Column:
    """Shares from 0 to 1 in percent, other values with two digits."""
    return F.when(value.isNull(), NONE).when(value.between(0, 1), F.format_string("%.0f%%", value * 100)).otherwise(F.format_string("%.2f", value))


def bias_text(bias: Column) -> Column:
    size = F.format_string("%.2f", F.abs(bias))
    return F.when(bias.isNull(), NONE).when(F.abs(bias) < 0.05, "基本无偏").when(bias > 0, F.concat(F.lit("judge 偏宽松 "), size, F.lit(" 分"))).otherwise(F.concat(F.lit("judge 偏严格 "), size, F.lit(" 分")))


def shift(left: Column, right: Column) -> Column:
    """13 → 0; nothing if both are 0."""
    return F.when((left == 0) & (right == 0), NONE).otherwise(F.format_string("%d → %d", left.cast("long"), right.cast("long")))


def intensity(count: Column, most: Column) -> Column:
    """0 to 1, for the cells of a heat map."""
    return F.when((most > 0) & (count > 0), F.least(F.lit(1.0), count / most)).otherwise(0.0)


def snippet(text: Column, n: int = 40) -> Column:
    """One line of at most ``n`` characters and an ellipsis; null if blank; whole if ``n`` isn't above 0."""
    line = F.nullif(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), F.lit(""))
    return line if n <= 0 else F.when(F.length(line) <= n, line).otherwise(F.concat(F.substring(line, 1, n), F.lit("…")))


def claims_summary(counts: dict[str, Column]) -> Column:
    """One line on a case's claims, from ``usage.label_counts``."""
    line = F.format_string("共 %d 条断言：supported %d / unsupported %d / irrelevant %d", *(counts[k] for k in ("claims", "supported", "unsupported", "irrelevant")))
    return F.when(counts["claims"] == 0, "共 0 条断言（答案没有可核查的断言）").otherwise(line)


def generation_summary(model: Column, prompt: Column, completion: Column, latency_ms: Column) -> Column:
    """model · 634+24 tokens · 3.2s; null without a model."""
    tokens = F.format_string("%d+%d tokens", F.coalesce(prompt, F.lit(0)).cast("long"), F.coalesce(completion, F.lit(0)).cast("long"))
    seconds = F.when(latency_ms > 0, F.format_string("%.1fs", latency_ms / 1000))
    return F.when(F.coalesce(model, F.lit("")) != "", F.concat_ws(" · ", model, tokens, seconds))


def closure_line(annotated: Column, fixed: Column, eligible: Column, worsened: Column, changed: Column, unverifiable: Column) -> Column:
    part = lambda n, form, *values: F.when(n > 0, F.format_string(form, *values))
    line = F.concat_ws(" ｜ ", F.format_string("已标 %d 题", annotated), part(fixed, "其中 fixed %d 题, %d 题确认变好可销单", fixed, eligible), part(worsened, "⚠ %d 题反而变坏", worsened), part(changed, "%d 题换了病因", changed), part(unverifiable, "%d 题判断不了", unverifiable))
    return F.when(annotated == 0, "这次 run 上还没有可核对的标注").otherwise(line)


def attribution_text(meta: Column) -> Column:
    """The rules and thresholds behind a run's flags; null without any."""
    return F.when(meta.isNotNull(), F.format_string("归因口径：规则 v%d · k=%d · 排序阈值 >%d · 达标线 ≤%d · 覆盖 %s", *(meta[c] for c in ("version", "k", "low_rank_limit", "quality_line", "scope"))))


def config_changes(left: Column, right: Column, knobs: list[str]) -> Column:
    """What differs between two structs of settings, as ``knob: old → new``."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return F.filter(F.array(*(F.when(~left[k].eqNullSafe(right[k]), F.concat(F.lit(f"{k}: "), text(left[k]), F.lit(" → "), text(right[k]))) for k in knobs)), lambda x: x.isNotNull())
