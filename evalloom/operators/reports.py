"""Reports over runs: paired comparison, signed ranks, calibration, closure, consistency."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.scoring import NOISE_FLOOR, kappa, rounded, transition
from evalloom.sources.scratch import written

METRICS = ("recall", "precision", "reciprocal_rank", "hit")
# Fixed value: the stratum of cases without one.
NO_STRATUM = "未分类"
#: Most non-zero differences whose p is exact.
EXACT = 25


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """The cases that both runs have, each with one row a side (``listing.latest`` picks one of several). Missing metrics read 0."""
    side = lambda df, p: df.select("qid", *(F.coalesce(c, F.lit(0.0)).alias(f"{p}_{c}") for c in METRICS), F.col("flags").alias(f"{p}_flags"))
    return side(left, "l").join(side(right, "r"), "qid")


def summary(pairs: DataFrame, noise: float = NOISE_FLOOR) -> DataFrame:
    """A row for each metric: rounded means, their rounded difference, cases that moved beyond the noise."""
    long = pairs.select("qid", F.expr("stack(4, " + ", ".join(f"'{c}', l_{c}, r_{c}" for c in METRICS) + ") as (metric, l, r)"))
    d = F.col("r") - F.col("l")
    out = long.groupBy("metric").agg(F.count("*").alias("cases"), rounded(F.avg("l")).alias("mean_left"), rounded(F.avg("r")).alias("mean_right"), F.count_if(d > noise).alias("improved"), F.count_if(d < -noise).alias("worsened"), F.count_if(F.abs(d) <= noise).alias("unchanged"))
    delta = rounded(F.col("mean_right") - F.col("mean_left"))
    return out.withColumn("delta", delta).withColumn("below_noise", F.abs("delta") <= noise)


def transitions(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("transition", transition(F.col("l_flags"), F.col("r_flags"))).groupBy("transition").agg(F.count("*").alias("cases"))


def strata(pairs: DataFrame, key: Column, noise: float = NOISE_FLOOR) -> DataFrame:
    d = F.col("r_recall") - F.col("l_recall")
    return pairs.groupBy(F.coalesce(key.cast("string"), F.lit(NO_STRATUM)).alias("stratum")).agg(
        F.count("*").alias("cases"), rounded(F.avg(d)).alias("mean_delta"), F.count_if(d > noise).alias("improved"), F.count_if(d < -noise).alias("worsened"), F.count_if(F.size("l_flags") > 0).alias("flagged_left"), F.count_if(F.size("r_flags") > 0).alias("flagged_right")
    )


def strata_by_flag(pairs: DataFrame) -> DataFrame:
    each = pairs.select("l_flags", "r_flags", F.explode(F.array_union("l_flags", "r_flags")).alias("flag"))
    return each.groupBy("flag").agg(F.count("*").alias("cases"), F.count_if(F.array_contains("l_flags", F.col("flag"))).alias("flagged_left"), F.count_if(F.array_contains("r_flags", F.col("flag"))).alias("flagged_right"))


def ordered_bits(x: Column) -> Column:
    """A double as a long of the same order: its exponent and mantissa, as they are stored. Null for NaN."""
    size = F.abs(x)
    e = F.floor(F.log2(size))
    m = size / F.pow(F.lit(2.0), e)
    e, m = F.when(m >= 2, e + 1).when(m < 1, e - 1).otherwise(e), F.when(m >= 2, m / 2).when(m < 1, m * 2).otherwise(m)
    bits = (e + 1023).cast("long") * F.lit(1 << 52) + ((m - 1) * float(1 << 52)).cast("long")
    # numbers under the smallest normal one are multiples of 2^-1074
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    least = F.when(F.isnan(x), F.lit(None)).when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.0**-1022, tiny).otherwise(bits)
    return F.when(x < 0, -least).otherwise(least)


#: Bits of a difference that its bin leaves open: a bin is a 65,536th of a power of two wide.
OPEN_BITS = 36


def _ranked(differences: DataFrame, by: list[str], value: str) -> DataFrame:
    """For each group: n without zeros, W+ with mid-ranks, the sum of t^3 - t over ties, and in ``ranks`` twice the ranks of up to ``EXACT`` with how often each comes.

    Equal sizes are counted first. Sizes are ranked within bins, and bins by their counts, so that no task sorts all
    sizes of a group: a bin's window has the different sizes of a narrow range, a group's window a row a bin. Ranks
    that small are few in any group, and all there are in a group of as many."""
    sizes = differences.withColumn("size", F.abs(value)).groupBy(*by, "size").agg(F.count("*").alias("rows"), F.count_if(F.col(value) > 0).alias("up"))
    counts = F.col("size") > 0
    ties = sizes.withColumn("t", F.when(counts, F.col("rows")).otherwise(0)).withColumn("bin", F.when(counts, F.shiftright(ordered_bits(F.col("size")), OPEN_BITS)).otherwise(-1))
    before = lambda w: F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = ties.groupBy(*by, "bin").agg(F.sum("t").alias("t"))
    bins = bins.withColumn("below", before(Window.partitionBy(*by).orderBy("bin"))).drop("t")
    inside = ties.withColumn("within", before(Window.partitionBy(*by, "bin").orderBy("size")))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "bin")]
    # mid-rank of a group of ties: those below it, and half of itself
    ranked = inside.alias("x").join(bins.alias("b"), same).select("x.*", "below").withColumn("rank", F.when(F.col("t") > 0, F.col("below") + F.col("within") + (F.col("t") + 1) / 2))
    few = F.when(F.col("rank") <= EXACT, F.struct((2 * F.col("rank")).cast("int").alias("rank2"), F.col("t").cast("int").alias("t")))
    return ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.coalesce(F.sum(F.col("rank") * F.col("up")), F.lit(0.0)).alias("w_plus"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tied"), F.collect_list(few).alias("ranks"))


def _with_z(ranked: DataFrame) -> DataFrame:
    n, d = F.col("n"), F.col("w_plus") - F.col("mean")
    out = ranked.withColumn("mean", n * (n + 1) / 4).withColumn("variance", n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    return out.withColumn("z", rounded(F.when(F.col("variance") > 0, (d + F.when(d > 0, -0.5).otherwise(0.5)) / F.sqrt("variance"))))


def signed_ranks(differences: DataFrame, by: list[str], value: str = "d") -> DataFrame:
    """For each group with a difference that isn't 0: n without zeros, W+ with mid-ranks, its mean, its variance with ties, z with continuity."""
    return _with_z(_ranked(differences, by, value).where("n > 0")).drop("tied", "ranks")


def exact_p(differences: DataFrame, by: list[str], value: str = "d") -> DataFrame:
    """For each group its two-sided p: for at most ``EXACT`` non-zero differences by a fold over the counts of all rank
    sums, beyond by the normal approximation of ``signed_ranks``; 1 where no difference is non-zero."""
    out = _with_z(_ranked(differences, by, value))
    few = (F.col("n") > 0) & (F.col("n") <= EXACT)
    ranks = F.flatten(F.transform("ranks", lambda r: F.array_repeat(r["rank2"], r["t"])))
    total, w2 = F.col("n") * (F.col("n") + 1), (2 * F.col("w_plus")).cast("long")
    start = F.transform(F.sequence(F.lit(0), F.least(total, F.lit(EXACT * (EXACT + 1))).cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(ranks, start, lambda c, r: F.transform(c, lambda x, i: x + F.when(i >= r, F.get(c, i - r)).otherwise(0.0)))
    tail = F.aggregate(F.slice(counts, 1, F.least(w2, total - w2).cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    exact = F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), F.col("n")))
    p = F.when(F.col("n") == 0, 1.0).when(few, rounded(exact)).otherwise(F.coalesce(rounded(normal_p(F.col("z"))), F.lit(1.0)))
    return out.select(*by, "n", "w_plus", p.alias("p"))


#: Bits of a value that each step of a median decides.
STEPS = (48, 32, 16, 0)


def exact_median(values: DataFrame, value: str) -> DataFrame:
    """One row, ``median``: of the values that aren't null or NaN; the mean of the two middle ones of an even number.

    The middle ranks are found by histograms of their leading bits, each of at most 65,536 rows, of the values that
    share the bits found before; no task sorts or holds the values. Values are counted and written once."""
    kept = values.select(F.col(value).cast("double").alias("v")).withColumn("k", ordered_bits(F.col("v"))).where("k is not null")
    counts = written(kept.groupBy("k").agg(F.first("v").alias("v"), F.count("*").alias("n")), "median")
    wanted = counts.agg(F.sum("n").alias("total")).select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor((F.col("total") + 1) / 2).alias("rank")), F.struct(F.lit(1).alias("side"), (F.floor(F.col("total") / 2) + 1).alias("rank")))).alias("x")).select("x.*", F.lit(None).cast("long").alias("prefix"))
    above = None
    for shift in STEPS:
        bits = counts.withColumn("bits", F.shiftright("k", shift)).withColumn("prefix", F.lit(0) if above is None else F.shiftright("k", above))
        near = bits.join(F.broadcast(wanted.withColumn("prefix", F.coalesce("prefix", F.lit(0)))), "prefix")
        cells = near.groupBy("side", "rank", "bits").agg(F.sum("n").alias("n"), F.min("v").alias("v"))
        up_to = F.sum("n").over(Window.partitionBy("side").orderBy("bits"))
        cells = cells.withColumn("up_to", up_to).where((F.col("up_to") >= F.col("rank")) & (F.col("up_to") - F.col("n") < F.col("rank")))
        wanted, above = cells.select("side", (F.col("rank") - F.col("up_to") + F.col("n")).alias("rank"), F.col("bits").alias("prefix"), "v"), shift
        last, wanted = wanted, wanted.drop("v")
    return last.agg(F.avg("v").alias("median"))


def score_noise(deltas: DataFrame, delta: str) -> DataFrame:
    """One row: pairs, the largest and the median absolute difference of scores; both null without pairs."""
    size = written(deltas.select(F.abs(delta).alias("size")), "deltas")
    out = size.agg(F.count("*").alias("pairs"), rounded(F.max("size")).alias("max_delta"))
    return out.crossJoin(F.broadcast(exact_median(size, "size"))).withColumn("median_delta", rounded("median")).drop("median")


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value."""

    @F.pandas_udf("double")
    def p(zs: pd.Series) -> pd.Series:
        return zs.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")

    return p(z)


def binary_calibration(pairs: DataFrame, judge: Column, human: Column) -> DataFrame:
    """One row from judge's and human's positives; nulls don't count."""
    count = lambda c: F.count_if(c)
    out = pairs.where(judge.isNotNull() & human.isNotNull()).agg(count(judge & human).alias("tp"), count(judge & ~human).alias("fp"), count(~judge & ~human).alias("tn"), count(~judge & human).alias("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    k = kappa(*(F.col(c) for c in ("tp", "fp", "tn", "fn")))
    return out.withColumn("pairs", n).withColumn("agreement", rounded((F.col("tp") + F.col("tn")) / n, 4)).withColumn("kappa", rounded(k, 4))


def score_calibration(pairs: DataFrame, judge: str, human: str) -> DataFrame:
    """One row from scores of 1 to 5; others don't count."""
    kept = pairs.where(F.col(judge).between(1, 5) & F.col(human).between(1, 5))
    d = F.abs(F.col(judge) - F.col(human))
    out = kept.agg(F.count("*").alias("pairs"), F.count_if(d == 0).alias("exact"), F.count_if(d <= 1).alias("within_one"), rounded(F.avg(d), 4).alias("mae"), rounded(F.avg(judge), 4).alias("judge_mean"), rounded(F.avg(human), 4).alias("human_mean"))
    return out.withColumn("bias", rounded(F.col("judge_mean") - F.col("human_mean"), 4))


def confusion(pairs: DataFrame, judge: str, human: str) -> DataFrame:
    """All 25 cells of the scores 1 to 5."""
    cells = pairs.sparkSession.range(25).select((F.expr("id div 5") + 1).alias("h"), (F.col("id") % 5 + 1).alias("j"))
    counts = pairs.groupBy(F.col(human).cast("long").alias("h"), F.col(judge).cast("long").alias("j")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["h", "j"], "left").select("h", "j", F.coalesce("n", F.lit(0)).alias("n"))


def closure(annotated: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """A row for each annotation: the verdict on its case between two runs, and whether it may be verified."""
    l, r = (df.select("qid", F.col("recall").alias(f"{p}_recall"), F.col("flags").alias(f"{p}_flags")) for df, p in ((before, "l"), (after, "r")))
    both = annotated.join(l, "qid").join(r, "qid", "left")
    t = transition(F.col("l_flags"), F.col("r_flags"))
    verdict = F.when(F.col("r_flags").isNull(), "unverifiable").otherwise(F.when(t == "fixed", "improved").when(t == "broke", "worsened").otherwise(t))
    evidence = F.when(F.col("l_recall").isNull() | F.col("r_recall").isNull(), "incomparable").when(F.abs(F.col("r_recall") - F.col("l_recall")) <= NOISE_FLOOR, "same").when(F.col("r_recall") > F.col("l_recall"), "better").otherwise("worse")
    out = both.withColumn("verdict", verdict).withColumn("evidence", evidence)
    return out.withColumn("eligible", (F.col("verdict") == "improved") & (F.col("status") == "fixed")).select("qid", "status", "verdict", "evidence", "eligible")


def consistency(left: DataFrame, right: DataFrame) -> DataFrame:
    """A row for each case of either run: which side has it, whether its ranked ids and flags agree, where they first part."""
    l, r = (df.select("qid", F.col("ids").alias(f"{p}_ids"), F.col("flags").alias(f"{p}_flags")) for df, p in ((left, "l"), (right, "r")))
    both = l.join(r, "qid", "full_outer")
    side = F.when(F.col("r_ids").isNull(), "left").when(F.col("l_ids").isNull(), "right").otherwise("both")
    parts = F.nullif(F.array_position(F.transform(F.arrays_zip("l_ids", "r_ids"), lambda x: ~x["l_ids"].eqNullSafe(x["r_ids"])), True), F.lit(0)) - 1
    shared = side == "both"
    return both.select("qid", side.alias("side"), F.when(shared, F.array_sort("l_ids") == F.array_sort("r_ids")).alias("same_set"), F.when(shared, F.array_sort("l_flags") == F.array_sort("r_flags")).alias("same_flags"), F.when(shared, parts).alias("first_divergence"))
