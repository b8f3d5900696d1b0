"""Whole reports that compare runs with one another and with people: A/B, closure, consistency, replay, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.scoring import FLAGS, NOISE_FLOOR, flags, kappa, rounded, transition
from evalloom.operators.listing import latest
from evalloom.operators.reports import exact_p

RETRIEVAL = ("recall", "reciprocal_rank", "hit", "precision")
GENERATION = ("claim_support_rate", "hallucination_rate", "irrelevant_rate", "helpfulness", "relevance")
#: Metrics of which less is better.
LESS_IS_BETTER = ("hallucination_rate", "irrelevant_rate")
MIN_SHARED, SIGNIFICANT = 0.5, 0.05
MIN_PAIRS, MIN_COVERAGE = 20, 0.5
# The order of a closure's records.
VERDICT_ORDER = ("improved", "worsened", "changed", "stable", "unverifiable")


def metric_values(case: Column, missing_as_zero: bool) -> dict[str, Column]:
    """The nine metrics of a case (a struct of the four, and of ``judge``), null where it has no value."""
    judge = case["judge"]
    out = {m: F.coalesce(case[m], F.lit(0.0)) if missing_as_zero else case[m] for m in RETRIEVAL}
    for name, label in zip(GENERATION[:3], ("supported", "unsupported", "irrelevant"), strict=True):
        out[name] = F.when(judge["claims"] > 0, judge[label] / judge["claims"])
    return out | {m: judge[m].cast("double") for m in GENERATION[3:]}


def paired_cases(left: DataFrame, right: DataFrame, order: str | None = None) -> DataFrame:
    """(qid, l, r) of the cases both runs have, the sides as structs; of a repeated qid on the right the last one counts."""
    right = latest(right, "qid", order) if order else right
    side = lambda df, name: df.select("qid", F.struct(*[c for c in df.columns if c != "qid"]).alias(name))
    return side(left, "l").join(side(right, "r"), "qid")


def metric_pairs(pairs: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """(qid, metric, l, r) of the pairs in which both sides have a value."""
    l, r = (metric_values(F.col(side), missing_as_zero) for side in ("l", "r"))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), l[m].cast("double").alias("l"), r[m].cast("double").alias("r")) for m in RETRIEVAL + GENERATION))
    return pairs.select("qid", F.explode(rows).alias("x")).select("qid", "x.*").where("l is not null and r is not null")


def higher_is_better(metric: Column) -> Column:
    return ~metric.isin(*LESS_IS_BETTER)


def ab_summary(values: DataFrame, noise: float = NOISE_FLOOR) -> DataFrame:
    """A row for each metric that has pairs: means, changes in the metric's good direction, p, and whether it's significant."""
    d = F.col("r") - F.col("l")
    gain = F.when(higher_is_better(F.col("metric")), d).otherwise(-d)
    out = values.groupBy("metric").agg(F.count("*").alias("cases"), rounded(F.avg("l")).alias("mean_left"), rounded(F.avg("r")).alias("mean_right"), F.count_if(gain > noise).alias("improved"), F.count_if(gain < -noise).alias("worsened"), F.count_if(F.abs(d) <= noise).alias("unchanged"))
    p = exact_p(values.select("metric", d.alias("d")), ["metric"]).select("metric", F.col("p").alias("p_value"))
    delta = rounded(F.col("mean_right") - F.col("mean_left"))
    out = out.join(p, "metric").withColumn("delta", delta).withColumn("below_noise", F.abs("delta") <= noise)
    return out.withColumn("higher_is_better", higher_is_better(F.col("metric"))).withColumn("significant", (F.col("p_value") < SIGNIFICANT) & ~F.col("below_noise"))


def comparability(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: cases of each side, shared and judged ones, and whether sharing is enough."""
    sizes = left.agg(F.count("*").alias("left_cases"), F.lit(0).alias("right_cases"), F.lit(0).alias("shared_cases"), F.lit(0).alias("judged_cases"))
    for df, shown in ((right, "right_cases"), (pairs, "shared_cases")):
        judged = F.count_if(F.col("l.judge").isNotNull() & F.col("r.judge").isNotNull()) if shown == "shared_cases" else F.lit(0)
        row = [F.count("*").alias(c) if c == shown else F.lit(0).alias(c) for c in ("left_cases", "right_cases", "shared_cases")]
        sizes = sizes.unionByName(df.agg(*row, judged.alias("judged_cases")))
    out = sizes.agg(*(F.sum(c).alias(c) for c in sizes.columns))
    few = F.col("shared_cases") < MIN_SHARED * F.greatest("left_cases", "right_cases")
    return out.withColumn("reason", F.when(F.col("shared_cases") == 0, "no shared cases").when(few, "too few shared cases").otherwise("")).withColumn("comparable", F.col("reason") == "")


def run_guard(pairs: DataFrame) -> DataFrame:
    """(left, right) run structs (id, dataset_id, attribution, all null for no run) with what keeps them apart and which side wasn't attributed."""
    l, r = F.col("left"), F.col("right")
    error = F.when((F.coalesce(l["id"], F.lit(0)) <= 0) | (F.coalesce(r["id"], F.lit(0)) <= 0), "no run").when(l["id"] == r["id"], "one run").when(l["dataset_id"] != r["dataset_id"], "other dataset").otherwise("")
    known = [F.coalesce(x["attribution"], F.lit(False)) for x in (l, r)]
    missing = F.when(known[0] & ~known[1], "right").when(~known[0] & known[1], "left").otherwise("")
    return pairs.withColumn("error", error).withColumn("attribution_missing", missing)


def transitions_of(pairs: DataFrame) -> DataFrame:
    """(qid, transition) of the cases whose flags changed."""
    return pairs.select("qid", transition(F.col("l.flags"), F.col("r.flags")).alias("transition")).where("transition <> 'stable'")


def flag_strata(pairs: DataFrame, noise: float = NOISE_FLOOR) -> DataFrame:
    """A row for each flag of either side, those that lost most cases first."""
    each = pairs.select("l", "r", F.explode(F.array_union("l.flags", "r.flags")).alias("flag"))
    d = F.coalesce("r.recall", F.lit(0.0)) - F.coalesce("l.recall", F.lit(0.0))
    has = lambda side: F.count_if(F.array_contains(f"{side}.flags", F.col("flag")))
    out = each.groupBy("flag").agg(F.count("*").alias("cases"), has("l").alias("flagged_left"), has("r").alias("flagged_right"), rounded(F.avg(d)).alias("mean_delta"), F.count_if(d > noise).alias("improved"), F.count_if(d < -noise).alias("worsened"))
    return out.orderBy(F.desc(F.col("flagged_left") - F.col("flagged_right")), "flag")


def closure_records(annotations: DataFrame, baseline: DataFrame, candidate: DataFrame, attribution_missing: bool = False, status: str | None = None) -> DataFrame:
    """A row for each annotation of a case the baseline has: verdict, why it can't be verified yet, and its place in the list."""
    if status:
        annotations = annotations.where(F.col("status") == status)
    both = annotations.join(baseline.select("qid", F.col("flags").alias("lf")), "qid").join(candidate.select("qid", F.col("flags").alias("rf")), "qid", "left")
    t = transition(F.col("lf"), F.col("rf"))
    unknown = F.col("rf").isNull() | F.lit(attribution_missing)
    verdict = F.when(unknown, "unverifiable").when(t == "fixed", "improved").when(t == "broke", "worsened").otherwise(t)
    out = both.withColumn("verdict", verdict)
    blocked = (
        F.when(F.col("rf").isNull(), "missing").when(F.lit(attribution_missing), "attribution")
        .when(F.col("verdict") == "worsened", "worsened").when(F.col("verdict") == "changed", "changed")
        .when(F.col("verdict") == "stable", F.when(F.size("rf") > 0, "same flags").otherwise("clean before"))
        .when(F.col("status") == "fixed", "").otherwise(F.concat(F.lit("still "), "status"))
    )
    order = F.lit(len(VERDICT_ORDER) - 1)
    for i, v in enumerate(VERDICT_ORDER[:-1]):
        order = F.when(F.col("verdict") == v, i).otherwise(order)
    out = out.withColumn("blocked", blocked).withColumn("eligible", (F.col("verdict") == "improved") & (F.col("status") == "fixed"))
    return out.withColumn("place", order.cast("long")).select("qid", "status", "verdict", "blocked", "eligible", "place").orderBy("place", "qid")


def closure_evidence(pairs: DataFrame, noise: float = NOISE_FLOOR) -> DataFrame:
    """(qid, metric, comparable, left, right, delta, direction) of all nine metrics; a side without a value makes it incomparable."""
    l, r = (metric_values(F.col(side), False) for side in ("l", "r"))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), l[m].cast("double").alias("l"), r[m].cast("double").alias("r")) for m in RETRIEVAL + GENERATION))
    out = pairs.select("qid", F.explode(rows).alias("x")).select("qid", "x.*").withColumn("comparable", F.col("l").isNotNull() & F.col("r").isNotNull())
    up = (F.col("r") > F.col("l")) == higher_is_better(F.col("metric"))
    direction = F.when(~F.col("comparable") | (F.abs(F.col("r") - F.col("l")) <= noise), "same").when(up, "better").otherwise("worse")
    shown = lambda c: F.when(F.col("comparable"), rounded(c, 4))
    return out.select("qid", "metric", "comparable", shown(F.col("l")).alias("left_value"), shown(F.col("r")).alias("right_value"), shown(F.col("r") - F.col("l")).alias("delta"), direction.alias("direction"))


def evidence_highlights(evidence: DataFrame, most: int = 3) -> DataFrame:
    """The first few of each case: what got worse, then better, then the same, then the incomparable; larger changes first."""
    rank = F.when(~F.col("comparable"), 3).when(F.col("direction") == "worse", 0).when(F.col("direction") == "better", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(rank, F.desc(F.coalesce(F.abs("delta"), F.lit(0.0))), "metric"))
    return evidence.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def closure_summary(records: DataFrame) -> DataFrame:
    of = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    status = lambda s: F.count_if(F.col("status") == s).alias(f"status_{s}")
    return records.agg(F.count("*").alias("annotated"), *map(of, VERDICT_ORDER), *map(status, ("open", "fixed", "verified", "wontfix")), F.count_if("eligible").alias("eligible_for_verify"))


def tolerant_equal(left: Column, right: Column, tolerance: float) -> Column:
    """Numbers within a tolerance; two nulls are equal, one isn't."""
    return F.coalesce(F.abs(left - right) <= tolerance, left.isNull() & right.isNull())


def metric_differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """For the cases of both runs: the metrics that differ, whether flags differ, and whether the ranked ids do."""
    both = paired_cases(left, right)
    bad = F.filter(F.array(*(F.when(~tolerant_equal(F.col(f"l.{k}").cast("double"), F.col(f"r.{k}").cast("double"), tolerance), F.lit(k)) for k in keys)), lambda x: x.isNotNull())
    return both.select("qid", bad.alias("metrics"), (~F.col("l.flags").eqNullSafe(F.col("r.flags"))).alias("flags_differ"), (~F.col("l.ids").eqNullSafe(F.col("r.ids"))).alias("order_differs"))


def consistency_verdict(left: DataFrame, right: DataFrame, runs: Column, keys: list[str], tolerance: float = 1e-9, strict: bool = False) -> DataFrame:
    """One row from two runs' cases and a struct of their (config_hash, dataset_id, corpus_id, status): counts of differences and the exit code.

    0 is consistent, 1 is not, 2 is incomparable: other settings, other data, or a run that hasn't succeeded. The order
    of ranked ids only counts if ``strict``."""
    l, r = runs["left"], runs["right"]
    reason = F.when(l["config_hash"] != r["config_hash"], "config").when((l["dataset_id"] != r["dataset_id"]) | (l["corpus_id"] != r["corpus_id"]), "data").when((l["status"] != "succeeded") | (r["status"] != "succeeded"), "status").otherwise("")
    diffs = metric_differences(left, right, keys, tolerance)
    only = lambda a, b, name: a.join(b, "qid", "left_anti").select(F.lit(name).alias("kind"))
    kinds = diffs.select(F.explode(F.filter(F.array(F.when((F.size("metrics") > 0) | F.col("flags_differ"), "case"), F.when(F.col("order_differs"), "order")), lambda x: x.isNotNull())).alias("kind"))
    kinds = kinds.unionByName(only(left, right, "left")).unionByName(only(right, left, "right"))
    count = lambda k: F.count_if(F.col("kind") == k)
    out = kinds.agg(count("case").alias("case_diffs"), count("order").alias("order_diffs"), count("left").alias("only_in_left"), count("right").alias("only_in_right")).withColumn("reason", reason)
    differ = (F.col("case_diffs") + F.col("only_in_left") + F.col("only_in_right") + (F.col("order_diffs") if strict else F.lit(0))) > 0
    return out.withColumn("exit_code", F.when(F.col("reason") != "", 2).when(differ, 1).otherwise(0).cast("long"))


def attribution_meta(k: int, judged: bool, ratio: float = 0.5, quality_line: int = 3, version: int = 1) -> Column:
    """What flags were made by: rules, scope and thresholds."""
    if not 0 < ratio <= 1 or not 1 <= quality_line <= 5 or k < 1:
        raise ValueError("bad thresholds")
    limit = max(1, -int(-k * ratio // 1))
    return F.struct(F.lit(version).alias("version"), F.lit("retrieval+judge" if judged else "retrieval").alias("scope"), F.lit(k).alias("k"), F.lit(limit).alias("low_rank_limit"), F.lit(ratio).alias("low_rank_ratio"), F.lit(quality_line).alias("quality_line"))


def resolved_k(from_snapshot: Column, retrieved_count: Column, default: int = 5) -> Column:
    """The k of a run: its settings', or else the largest number that a case retrieved (an aggregate), or else the default."""
    most = F.max(retrieved_count)
    return F.when(F.max(from_snapshot) > 0, F.max(from_snapshot)).when(most > 0, most).otherwise(default)


def hits_of(m: Column) -> Column:
    """Hits of a case: their number where it is known, or else that of its recall (half to even), at least 1 if it hit."""
    known = F.coalesce(m["hits"], F.bround(F.coalesce(m["recall"], F.lit(0.0)) * F.greatest(F.coalesce(m["gold_count"], F.lit(0)), F.lit(0)), 0).cast("long"))
    known = F.greatest(known, F.lit(0))
    return F.when((known == 0) & (F.coalesce(m["hit"], F.lit(0.0)) > 0), 1).otherwise(known)


def ordered_flags(flags: Column) -> Column:
    """Known flags by priority, then the others in the order they have."""
    known = F.array(*map(F.lit, FLAGS))
    return F.concat(F.filter(known, lambda f: F.array_contains(flags, f)), F.filter(flags, lambda f: ~F.array_contains(known, f)))


def replay(old: DataFrame, new: DataFrame) -> DataFrame:
    """(qid, old_flags, new_flags, changed): what attribution would write now beside what is stored."""
    both = old.select("qid", F.col("flags").alias("old_flags")).join(new.select("qid", F.col("flags").alias("new_flags")), "qid")
    return both.withColumn("changed", F.array_sort("old_flags") != F.array_sort("new_flags"))


def suggestion(flags: Column, judged: Column, family: Column) -> Column:
    """A cause for an annotation: the first flag's family, but no hallucination where nothing was judged."""
    return F.when(~judged & (family == "hallucination"), "unknown").otherwise(family)


def annotator_counts(gold: DataFrame) -> DataFrame:
    """(annotator, rows, place by name, primary): the one with most rows, the first name among equals, is the primary one."""
    n = gold.groupBy("annotator").agg(F.count("*").alias("rows"))
    first = Window.partitionBy().orderBy(F.desc("rows"), "annotator")
    by_name = Window.partitionBy().orderBy("annotator")
    return n.withColumn("primary", F.row_number().over(first) == 1).withColumn("place", F.row_number().over(by_name))


def calibration_report(gold: DataFrame, total_cases: int) -> DataFrame:
    """One row on the primary annotator's gold beside the judge.

    ``gold`` has case_id, annotator, verdict (faithful, hallucinated or unclear), reviewed, judge_bad (null without an opinion)."""
    names = annotator_counts(gold)
    own = gold.join(F.broadcast(names.where("primary").select("annotator")), "annotator")
    opinion, human = F.col("judge_bad").isNotNull(), F.col("verdict") == "hallucinated"
    clear = opinion & (F.col("verdict") != "unclear")
    of = lambda j, h: F.count_if(clear & (F.col("judge_bad") == j) & (human == h))
    out = own.agg(
        F.max("annotator").alias("primary_annotator"), F.count_distinct("case_id").alias("cases_with_gold"), F.count_if(opinion).alias("gold_judged"), F.count_if(~opinion).alias("gold_unjudged"), F.count_if("reviewed").alias("gold_reviewed"),
        of(True, True).alias("tp"), of(True, False).alias("fp"), of(False, False).alias("tn"), of(False, True).alias("fn"), F.count_if(opinion & (F.col("verdict") == "unclear")).alias("excluded_unclear"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    pairs = tp + fp + tn + fn
    some = lambda c: F.when(F.col("pairs") > 0, c)
    out = out.withColumn("pairs", pairs).withColumn("judge_positives", tp + fp).withColumn("human_positives", tp + fn)
    out = out.withColumn("agreement", some(rounded(F.try_divide(tp + tn, F.col("pairs")), 4))).withColumn("kappa", some(rounded(kappa(tp, fp, tn, fn), 4)))
    out = out.withColumn("coverage", rounded(F.col("cases_with_gold") / total_cases, 4) if total_cases else F.lit(0.0))
    out = out.join(names.agg(F.count("*").alias("annotators")), F.lit(True))
    notes = {
        "one annotator": F.col("annotators") < 2, "few pairs": (F.col("pairs") > 0) & (F.col("pairs") < MIN_PAIRS), "low coverage": F.col("coverage") < MIN_COVERAGE, "unclear": F.col("excluded_unclear") > 0,
        "not reviewed": (F.col("cases_with_gold") >= MIN_PAIRS) & (F.col("gold_reviewed") == 0), "reviewed": F.col("gold_reviewed") > 0, "missed": fn > 0, "unjudged": F.col("gold_unjudged") > 0,
    }
    noted = F.array_join(F.filter(F.array(*(F.when(on, F.lit(n)) for n, on in notes.items())), lambda x: x.isNotNull()), ",")
    return out.withColumn("notes", noted).withColumn("usable", (F.col("pairs") >= MIN_PAIRS) & (F.col("coverage") >= MIN_COVERAGE))


def between_annotators(gold: DataFrame) -> DataFrame:
    """One row on the first two annotators by name: kappa of clear verdicts and agreement of scores, each from two pairs on."""
    names = F.broadcast(annotator_counts(gold).where("place <= 2").select("annotator", "place"))
    rows = gold.join(names, "annotator")
    side = lambda n, p: rows.where(F.col("place") == n).select("case_id", F.col("annotator").alias(f"{p}_name"), F.col("verdict").alias(f"{p}_verdict"), F.col("helpfulness").alias(f"{p}_score"))
    both = side(1, "a").join(side(2, "b"), "case_id")
    clear = (F.col("a_verdict") != "unclear") & (F.col("b_verdict") != "unclear")
    a, b = F.col("a_verdict") == "hallucinated", F.col("b_verdict") == "hallucinated"
    d = F.abs(F.col("a_score") - F.col("b_score"))
    out = both.agg(F.max("a_name").alias("annotator_a"), F.max("b_name").alias("annotator_b"), F.count_if(clear).alias("n"), F.count_if(clear & a & b).alias("tp"), F.count_if(clear & a & ~b).alias("fp"), F.count_if(clear & ~a & ~b).alias("tn"), F.count_if(clear & ~a & b).alias("fn"), F.count(d).alias("score_pairs"), rounded(F.avg(d), 4).alias("mae"), rounded(F.avg((d == 0).cast("double")), 4).alias("exact"))
    enough, scored = F.col("n") >= 2, F.col("score_pairs") >= 2
    k = rounded(kappa(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))), 4)
    return out.select("annotator_a", "annotator_b", F.when(enough, F.col("n")).otherwise(0).alias("binary_pairs"), F.when(enough, k).alias("binary_kappa"), "score_pairs", F.when(scored, F.col("mae")).alias("score_mae"), F.when(scored, F.col("exact")).alias("score_exact_rate")).where("binary_pairs > 0 or score_pairs > 0")


# Runs as stored: metrics are maps of whatever keys a run has.
def map_differences(left: Column, right: Column, tolerance: float = 1e-9, ignored: tuple[str, ...] = ()) -> Column:
    """The keys, in order, under which two maps of numbers differ; a key that only one of them has differs, unless it's null there."""
    nothing = F.create_map().cast("map<string,double>")
    same = F.map_zip_with(F.coalesce(left, nothing), F.coalesce(right, nothing), lambda _, a, b: tolerant_equal(a, b, tolerance))
    return F.array_sort(F.map_keys(F.map_filter(same, lambda k, equal: ~equal & ~k.isin(*ignored) if ignored else ~equal)))


def consistency_outcomes(pairs: DataFrame, cases: DataFrame, tolerance: float = 1e-9, ignored: tuple[str, ...] = ()) -> DataFrame:
    """A row for each pair (pair, left, right, strict) of run structs (run_id, config_hash, dataset_id, corpus_id, status, metrics).

    ``cases`` (run_id, qid, metrics, flags, ids) are those of all runs, read once for each side. ``reasons`` say why a
    pair can't be compared (exit code 2); else it is consistent (0) unless metrics of the runs, metrics or flags of a
    case, or the sets of cases differ (1). Another order of ranked ids only counts if the pair is ``strict``."""
    l, r = F.col("left"), F.col("right")
    found = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    settings = found(F.when(~l["config_hash"].eqNullSafe(r["config_hash"]), "config"), F.when(~l["dataset_id"].eqNullSafe(r["dataset_id"]) | ~l["corpus_id"].eqNullSafe(r["corpus_id"]), "data"))
    unfinished = F.when((l["status"] != "succeeded") | (r["status"] != "succeeded"), F.array(F.lit("status"))).otherwise(F.array().cast("array<string>"))
    told = pairs.withColumn("reasons", F.when(F.size(settings) > 0, settings).otherwise(unfinished)).withColumn("run_differences", map_differences(l["metrics"], r["metrics"], tolerance, ignored))
    able = told.where(F.size("reasons") == 0)
    side = lambda name: able.select("pair", F.col(f"{name}.run_id").alias("run_id")).join(cases, "run_id").select("pair", "qid", F.struct("metrics", "flags", "ids").alias(name))
    both = side("left").join(side("right"), ["pair", "qid"], "full_outer")
    shared = l.isNotNull() & r.isNotNull()
    changed = (F.size(map_differences(l["metrics"], r["metrics"], tolerance, ignored)) > 0) | ~l["flags"].eqNullSafe(r["flags"])
    counts = both.groupBy("pair").agg(F.count_if(shared & changed).alias("case_diffs"), F.count_if(shared & ~l["ids"].eqNullSafe(r["ids"])).alias("order_diffs"), F.count_if(r.isNull()).alias("only_in_left"), F.count_if(l.isNull()).alias("only_in_right"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = told.join(counts, "pair", "left").select("pair", "strict", "reasons", F.when(F.size("reasons") == 0, F.col("run_differences")).otherwise(F.array().cast("array<string>")).alias("run_differences"), *map(n, ("case_diffs", "order_diffs", "only_in_left", "only_in_right")))
    differ = (F.size("run_differences") > 0) | (F.col("case_diffs") + F.col("only_in_left") + F.col("only_in_right") > 0) | (F.col("strict") & (F.col("order_diffs") > 0))
    return out.withColumn("exit_code", F.when(F.size("reasons") > 0, 2).when(differ, 1).otherwise(0))


def replayed(results: DataFrame, runs: DataFrame, ratio: float = 0.5, quality_line: int = 3) -> DataFrame:
    """(run_id, qid, k, old_flags, new_flags, changed): flags made again from stored metrics and judgements.

    ``results`` have run_id, qid, metrics (gold_count, retrieved_count, hits, recall, hit, first_hit_rank), judge and
    flags; ``runs`` run_id and ``top_k`` of their settings. k is the settings', or else the most that a case of the run
    retrieved, or else 5. Nothing is searched or judged."""
    most = results.groupBy("run_id").agg(F.max("metrics.retrieved_count").alias("most"))
    ks = runs.join(most, "run_id", "left").select("run_id", F.when(F.col("top_k") > 0, F.col("top_k")).when(F.col("most") > 0, F.col("most")).otherwise(5).alias("k"))
    met = results.join(F.broadcast(ks), "run_id")
    m = F.struct(F.col("metrics.gold_count").alias("gold_count"), hits_of(F.col("metrics")).alias("hits"), F.col("metrics.first_hit_rank").alias("first_hit_rank"))
    out = met.select("run_id", "qid", "k", F.coalesce("flags", F.array().cast("array<string>")).alias("old_flags"), flags(m, F.col("judge"), F.col("k"), ratio, quality_line).alias("new_flags"))
    return out.withColumn("changed", F.array_sort("old_flags") != F.array_sort("new_flags"))
