"""Whole reports and their exports: one run, two runs, calibration; previews of a pipeline and the contexts of a case.

Exports are rows (block, part, first, key, text): ordered by the first four they are the lines of a file. Only lines
about metrics and strata are few; those about cases are as many as there are, so lines aren't numbered by one task,
and ``write_lines`` sorts them by ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions import formats
from evalloom.functions.scoring import NOISE_FLOOR, csv_cell, rounded, transition
from evalloom.operators import experiments as X
from evalloom.operators import listing as L
from evalloom.operators import prompting as P
from evalloom.operators import reports
from evalloom.operators.passages import STRATEGIES
from evalloom.operators.reports import NO_STRATUM
from evalloom.sources.scratch import written

# What flags and metrics are called in exports.
FLAG_LABELS = {
    "no_gold": "数据集缺 gold(不可评测)",
    "anchor_incomplete": "锚点漏标(答案其实有据)",
    "retrieval_miss": "检索漏召回(全未命中)",
    "retrieval_partial": "检索部分漏召回",
    "retrieval_low_rank": "命中但排序靠后",
    "hallucination": "幻觉(有断言无据)",
    "off_topic": "答非所问(断言与问题无关)",
    "generation_quality": "生成质量不达标",
    "no_claims": "无可核查断言",
}
PAIRED_LABELS = {
    "recall": "Recall@k",
    "reciprocal_rank": "MRR@k",
    "hit": "Hit@k",
    "precision": "Precision@k",
    "claim_support_rate": "断言支持率",
    "hallucination_rate": "幻觉率",
    "irrelevant_rate": "无关断言率",
    "helpfulness": "helpfulness 均值",
    "relevance": "relevance 均值",
}
RUN_LABELS = {
    "recall_at_k": "Recall@k",
    "precision_at_k": "Precision@k",
    "mrr_at_k": "MRR@k",
    "hit_at_k": "Hit@k",
    "avg_hits": "平均命中数",
    "avg_gold_chunks": "平均 gold 数",
    "cases_total": "题目总数",
    "cases_evaluated": "参与评测题数",
    "cases_skipped_no_gold": "因缺 gold 跳过",
    "answers_generated": "生成答案题数",
    "cases_judged": "判定题数",
    "claim_support_rate": "断言支持率",
    "hallucination_rate": "幻觉率",
    "irrelevant_rate": "无关断言率",
    "claims_total": "断言总数",
    "claims_supported": "有据断言数",
    "claims_unsupported": "无据断言数",
    "claims_irrelevant": "无关断言数",
    "avg_claims_per_answer": "平均断言数",
    "relevance_avg": "relevance 均值",
    "helpfulness_avg": "helpfulness 均值",
    "rubric_cases": "打分题数",
    "judge_cache_hits": "judge 缓存命中",
    "judge_prompt_tokens": "judge prompt tokens",
    "judge_completion_tokens": "judge completion tokens",
    "prompt_tokens": "生成 prompt tokens",
    "completion_tokens": "生成 completion tokens",
}
CLEAN = "干净"
MOVED = {"fixed": "修好", "broke": "变坏", "changed": "标签变化"}
STRATA = {"category": "类别", "difficulty": "难度", "flag": "归因标签"}
YES, NO = "是", "否"

LINES = ["block", "part", "first", "key", "text"]


def label(name: Column, labels: dict[str, str]) -> Column:
    """A name's label; names without one stay as they are."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[name], name)


def number(value: Column) -> Column:
    """A number of at most six digits after the point, without zeros at its end; null stays null."""
    return F.when(value.isNotNull(), F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"\.?0+$", ""))


def line(*cells: Column) -> Column:
    return F.concat_ws(",", *(F.coalesce(csv_cell(c), F.lit("")) for c in cells))


def as_lines(df: DataFrame, block: int, part: int, text: Column, first: Column | None = None, key: Column | None = None) -> DataFrame:
    return df.select(F.lit(block).alias("block"), F.lit(part).alias("part"), (F.lit(0.0) if first is None else first.cast("double")).alias("first"), (F.lit("") if key is None else key).alias("key"), text.alias("text"))


def literal(df: DataFrame, block: int, part: int, *cells: str) -> DataFrame:
    return as_lines(df.sparkSession.range(1), block, part, line(*map(F.lit, cells)) if cells else F.lit(""))


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines in order, as text files whose names have that order."""
    lines.orderBy("block", "part", "first", "key").select("text").write.mode("overwrite").text(path)


# ---- two runs ----
@dataclass
class ABReport:
    """``head`` is one row; ``summary``, ``moved`` and ``strata`` are empty unless it says that the runs can be compared."""

    head: DataFrame
    summary: DataFrame
    moved: DataFrame
    strata: DataFrame

    def written(self) -> ABReport:
        """The report as tables, for exports, which read its parts several times."""
        return ABReport(*(written(getattr(self, n), f"report-{n}") for n in ("head", "summary", "moved", "strata")))


def last_each(cases: DataFrame, order: str | None) -> DataFrame:
    return L.latest(cases, "qid", order) if order else cases


def ab_report(left: DataFrame, right: DataFrame, left_attributed: bool = True, right_attributed: bool = True, generation: bool = True, noise: float = NOISE_FLOOR, order: str | None = None) -> ABReport:
    """Two runs' cases (qid, category, difficulty, the four metrics, flags, judge) compared.

    Of a case that a side has several times the last by ``order`` counts. Nothing but the head is said of runs that
    share too few cases. The sides are read several times: write them before if they cost something."""
    left, right = last_each(left, order), last_each(right, order)
    pairs = X.paired_cases(left, right)
    missing = "right" if left_attributed and not right_attributed else "left" if right_attributed and not left_attributed else ""
    head = X.comparability(left, right, pairs).withColumn("attribution_missing", F.lit(missing)).withColumn("noise_floor", F.lit(noise))
    note = F.when(F.lit(generation) & F.col("comparable") & (F.col("judged_cases") == 0), "nothing judged").otherwise("")
    head = head.withColumn("generation_note", note)
    able = F.broadcast(head.where("comparable").select(F.lit(1).alias("_able")))
    shared = pairs.join(able).drop("_able")
    values = X.metric_pairs(shared)
    summary = X.ab_summary(values if generation else values.where(F.col("metric").isin(*X.RETRIEVAL)), noise)
    moved = shared.select("qid", F.col("l.category").alias("category"), F.col("l.difficulty").alias("difficulty"), transition(F.col("l.flags"), F.col("r.flags")).alias("transition"), F.col("l.flags").alias("flags_left"), F.col("r.flags").alias("flags_right")).where("transition <> 'stable'")
    d = F.coalesce("r.recall", F.lit(0.0)) - F.coalesce("l.recall", F.lit(0.0))
    each = shared.select("l.category", "l.difficulty", d.alias("d"), (F.size("l.flags") > 0).alias("lf"), (F.size("r.flags") > 0).alias("rf"))
    by = F.explode(F.array(*(F.struct(F.lit(n).alias("by"), F.coalesce(F.col(n).cast("string"), F.lit(NO_STRATUM)).alias("key")) for n in ("category", "difficulty"))))
    strata = each.select("d", "lf", "rf", by.alias("x")).groupBy("x.by", "x.key").agg(F.count("*").alias("cases"), rounded(F.avg("d")).alias("mean_delta"), F.count_if(F.col("d") > NOISE_FLOOR).alias("improved"), F.count_if(F.col("d") < -NOISE_FLOOR).alias("worsened"), F.count_if("lf").alias("flagged_left"), F.count_if("rf").alias("flagged_right"))
    flags = X.flag_strata(shared).select(F.lit("flag").alias("by"), F.col("flag").alias("key"), "cases", "mean_delta", "improved", "worsened", "flagged_left", "flagged_right")
    return ABReport(head, summary, moved, strata.unionByName(flags))


def stratum_order(by: str) -> Column:
    """Categories and difficulties that lost most recall first, flags that lost most cases first."""
    return F.col("flagged_right") - F.col("flagged_left") if by == "flag" else F.col("mean_delta")


def joined_flags(flags: Column, labels: dict[str, str] | None = None) -> Column:
    named = F.transform(flags, lambda f: label(f, labels)) if labels else flags
    return F.when(F.size(flags) > 0, F.array_join(named, " + ")).otherwise(CLEAN)


def ab_csv(report: ABReport, left: int, right: int) -> DataFrame:
    """Three blocks: the summary, the cases that moved, the strata. The parts are read several times: see ``ABReport.written``."""
    yes = lambda c: F.when(c, YES).otherwise(NO)
    h, s = report.head, report.summary
    out = [literal(h, 1, 0, "对比", f"run {left}", f"run {right}"), as_lines(h, 1, 1, line(F.lit("共同题目"), number(F.col("shared_cases")), F.lit(""))), as_lines(h, 1, 2, line(F.lit("噪声底"), number(F.col("noise_floor")), F.lit("")))]
    out += [as_lines(h, 1, 3, line(F.lit("可比"), F.when(F.col("comparable"), YES).otherwise(F.concat(F.lit(f"{NO}("), "reason", F.lit(")"))), F.lit(""))), literal(h, 1, 4, "指标", "左", "右", "差值", "改善题数", "恶化题数", "p值", "是否显著", "是否落在噪声底内")]
    out.append(as_lines(s, 1, 5, line(label(F.col("metric"), PAIRED_LABELS), *(number(F.col(c)) for c in ("mean_left", "mean_right", "delta", "improved", "worsened", "p_value")), yes(F.col("significant")), yes(F.col("below_noise"))), key=F.col("metric")))
    out += [literal(h, 2, -1), literal(h, 2, 0, "翻转题", "qid", "类别", "难度", "左侧标签", "右侧标签")]
    for n, (kind, shown) in enumerate(MOVED.items(), 1):
        rows = report.moved.where(F.col("transition") == kind)
        out.append(as_lines(rows, 2, n, line(F.lit(shown), *(F.col(c).cast("string") for c in ("qid", "category", "difficulty")), joined_flags(F.col("flags_left")), joined_flags(F.col("flags_right"))), key=F.col("qid").cast("string")))
    out += [literal(h, 3, -1), literal(h, 3, 0, "分层", "分组", "题数", "Recall 均值差", "改善", "恶化", "左侧有标签", "右侧有标签")]
    for n, (by, shown) in enumerate(STRATA.items(), 1):
        rows = report.strata.where(F.col("by") == by)
        out.append(as_lines(rows, 3, n, line(F.lit(shown), F.col("key"), *(number(F.col(c)) for c in ("cases", "mean_delta", "improved", "worsened", "flagged_left", "flagged_right"))), stratum_order(by), F.col("key")))
    return together(out)


def ab_markdown(report: ABReport, left: int, right: int) -> DataFrame:
    """A title, and for runs that can be compared their metrics, the cases that moved and the strata; of others only why not."""
    h = report.head
    yes, no = h.where("comparable"), h.where("not comparable")
    text = lambda df, block, part, value: as_lines(df, block, part, F.lit(value) if isinstance(value, str) else value)
    out = [text(h, 1, 0, f"# A/B 对比：run #{left}（左）vs run #{right}（右）"), text(no, 1, 1, ""), text(no, 1, 2, F.concat(F.lit("> ⚠️ 不可比："), "reason"))]
    out += [text(yes, 1, 1, ""), text(yes, 1, 2, F.concat(F.lit("共同题目 "), "shared_cases", F.lit(" 题（左 "), "left_cases", F.lit(" / 右 "), "right_cases", F.lit("）｜差值小于 "), number(F.col("noise_floor")), F.lit(" 视为落在噪声里")))]
    warned = yes.where("attribution_missing <> ''")
    out += [text(warned, 1, 3, ""), text(warned, 1, 4, F.concat(F.lit("> ⚠️ "), "attribution_missing"))]
    out += [text(yes, 2, n, t) for n, t in enumerate(("", "## 指标", "", "| 指标 | 左 | 右 | 差值 | 改善 | 恶化 | p 值 | 结论 |", "|---|---|---|---|---|---|---|---|"))]
    verdict = F.when(F.col("below_noise"), "噪声内").when(F.col("significant"), "显著").otherwise("不显著")
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    name = F.concat(label(F.col("metric"), PAIRED_LABELS), F.when(F.col("higher_is_better"), "").otherwise("（越低越好）"))
    out.append(as_lines(report.summary, 2, 9, row(name, number(F.col("mean_left")), number(F.col("mean_right")), formats.points(F.col("delta")), *(number(F.col(c)) for c in ("improved", "worsened", "p_value")), F.concat(verdict, F.lit("（"), F.col("cases").cast("string"), F.lit(" 题）"))), key=F.col("metric")))
    titles = {"fixed": "修好的题", "broke": "变坏的题", "changed": "标签变化但不好不坏"}
    counts = report.moved.agg(*(F.count_if(F.col("transition") == k).alias(k) for k in titles)).join(F.broadcast(yes.select(F.lit(1).alias("_able")))).drop("_able")
    for block, (kind, title) in enumerate(titles.items(), 3):
        said = counts if kind != "changed" else counts.where("changed > 0")
        out += [text(said, block, 0, ""), text(said, block, 1, F.concat(F.lit(f"## {title}（"), kind, F.lit("）")))]
        if kind != "changed":
            out.append(text(counts.where(F.col(kind) == 0), block, 2, "- 无"))
        rows = report.moved.where(F.col("transition") == kind)
        out.append(as_lines(rows, block, 3, F.concat(F.lit("- "), F.col("qid").cast("string"), F.lit("："), joined_flags(F.col("flags_left"), FLAG_LABELS), F.lit(" → "), joined_flags(F.col("flags_right"), FLAG_LABELS)), key=F.col("qid").cast("string")))
    for block, (by, title) in enumerate({"category": "按类别", "difficulty": "按难度", "flag": "按归因标签"}.items(), 6):
        rows = report.strata.where(F.col("by") == by)
        some = rows.agg(F.count("*").alias("n")).where("n > 0")
        out += [text(some, block, n, t) for n, t in enumerate(("", f"## {title}", "", "| 分组 | 题数 | Recall 均值差 | 改善 | 恶化 | 有标签(左→右) |", "|---|---|---|---|---|---|"))]
        out.append(as_lines(rows, block, 9, row(F.col("key"), number(F.col("cases")), formats.points(F.col("mean_delta")), number(F.col("improved")), number(F.col("worsened")), formats.shift(F.col("flagged_left"), F.col("flagged_right"))), stratum_order(by), F.col("key")))
    return together(out)


# ---- one run ----
def run_reports(runs: DataFrame, results: DataFrame, worst: int = 10) -> DataFrame:
    """``runs`` (run_id, metrics as a map of numbers, ...) with ``worst_cases`` (those with the lowest recall, ties by case) and ``flag_counts`` (most frequent first).

    ``results`` have run_id, qid, recall, reciprocal_rank, hit, flags, claims (their labels, null if not judged) and answer."""
    w = Window.partitionBy("run_id").orderBy(F.col("recall").asc_nulls_last(), "qid")
    lowest = results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= L.clamped(worst, 10, 500))
    case = F.struct("place", "qid", "recall", "reciprocal_rank", "hit", "flags", "claims", "answer")
    lowest = lowest.groupBy("run_id").agg(F.array_sort(F.collect_list(case)).alias("worst_cases"))
    counts = results.select("run_id", F.explode("flags").alias("flag")).groupBy("run_id", "flag").agg(F.count("*").alias("n"))
    counts = counts.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "flag", "n"))), lambda x: F.struct(x["flag"], x["n"])).alias("flag_counts"))
    out = runs.join(lowest, "run_id", "left").join(counts, "run_id", "left")
    return out.withColumn("worst_cases", F.coalesce("worst_cases", F.array())).withColumn("flag_counts", F.coalesce("flag_counts", F.array()))


def run_json(report: Column | None = None) -> Column:
    """A report's row as one JSON object."""
    return F.to_json(F.struct("run_id", "metrics", F.transform("worst_cases", lambda c: F.struct(c["qid"], c["recall"], c["flags"])).alias("worst_cases"), F.map_from_entries("flag_counts").alias("flag_counts")))


def _csv(rows: Column) -> Column:
    return F.array_join(rows, "\n")


def run_csv(head: list[tuple[str, str]]) -> Column:
    """A row of ``run_reports`` as a file of four blocks; ``head`` are titles and columns of the first one."""
    one = F.concat_ws("\n", *(line(F.lit(title), F.col(c).cast("string")) for title, c in head))
    names = F.filter(F.array_sort(F.map_keys("metrics")), lambda k: ~k.startswith("attribution"))
    two = F.concat_ws("\n", line(F.lit("指标"), F.lit("值")), _csv(F.transform(names, lambda k: line(label(k, RUN_LABELS), number(F.col("metrics")[k])))))
    three = F.when(F.size("flag_counts") > 0, F.concat_ws("\n", line(F.lit("归因标签"), F.lit("题数")), _csv(F.transform("flag_counts", lambda f: line(label(f["flag"], FLAG_LABELS), f["n"].cast("string"))))))
    of = lambda c, name: F.size(F.filter(c["claims"], lambda x: x == name)).cast("string")
    counted = lambda c: F.when(F.size(c["claims"]) > 0, F.concat_ws("/", of(c, "supported"), of(c, "unsupported"), of(c, "irrelevant"))).otherwise(formats.NONE)
    cause = lambda c: F.coalesce(label(F.get(c["flags"], F.lit(0)), FLAG_LABELS), F.lit(formats.NONE))
    four = F.concat_ws("\n", line(*map(F.lit, ("qid", "主因", "断言(支持/无据/无关)", "recall", "MRR", "命中", "答案摘要"))), F.nullif(_csv(F.transform("worst_cases", lambda c: line(c["qid"].cast("string"), cause(c), counted(c), number(c["recall"]), number(c["reciprocal_rank"]), number(c["hit"]), formats.snippet(c["answer"], 60)))), F.lit("")))
    return F.concat_ws("\n\n", one, two, three, four)


def run_markdown(dataset: str, corpus: str, status: str, config_hash: str, git_sha: str, made: str) -> Column:
    """A row of ``run_reports`` for people: rates and the distribution of flags, without single cases. The arguments are columns."""
    m = lambda k: F.col("metrics")[F.lit(k)]
    row = lambda k: F.when(m(k).isNotNull(), F.concat(F.lit("| "), F.lit(RUN_LABELS[k]), F.lit(" | "), formats.percent(m(k)), F.lit(" |")))
    table = F.concat_ws("\n", F.lit("## 指标"), F.lit(""), F.lit("| 指标 | 值 |"), F.lit("| --- | --- |"), *map(row, ("recall_at_k", "precision_at_k", "mrr_at_k", "hit_at_k")))
    rate = lambda k: F.concat(F.lit(f"| {RUN_LABELS[k]} | "), formats.percent(m(k)), F.lit(" |"))
    judged = F.when(m("cases_judged").isNotNull() | m("answers_generated").isNotNull(), F.concat_ws("\n", F.lit("\n## 生成与判定"), F.lit(""), F.lit("| 指标 | 值 |"), F.lit("| --- | --- |"), rate("hallucination_rate"), rate("claim_support_rate"), rate("irrelevant_rate"), F.concat(F.lit("| 判定题数 | "), F.coalesce(number(m("cases_judged")), F.lit(formats.NONE)), F.lit(" |"))))
    flags = F.when(F.size("flag_counts") > 0, F.concat(F.lit("\n## 归因标签分布\n\n"), F.array_join(F.transform("flag_counts", lambda f: F.concat(F.lit("- "), label(f["flag"], FLAG_LABELS), F.lit(": "), f["n"].cast("string"))), "\n")))
    of = F.concat(F.lit("- 评测集: dataset "), F.col(dataset).cast("string"), F.when(F.coalesce(F.col(corpus), F.lit(0)) != 0, F.concat(F.lit(" · corpus "), F.col(corpus).cast("string"))).otherwise(""))
    head = F.concat_ws("\n", F.concat(F.lit("# run #"), F.col("run_id").cast("string"), F.lit(" 评测报告")), F.lit(""), of, F.concat(F.lit("- 状态: "), status), F.concat(F.lit("- config_hash: `"), config_hash, F.lit("` · git_sha: `"), git_sha, F.lit("`")), F.concat(F.lit("- 生成时间: "), made), F.lit(""))
    return F.concat_ws("\n", head, table, judged, flags, F.lit("\n> 逐题明细（含每题的断言与答案摘要）见同目录的 CSV 导出。"))


# ---- calibration ----
def calibration(gold: DataFrame, total_cases: int, most: int = 50) -> DataFrame:
    """One row: ``experiments.calibration_report``, with the calibration of both scores, the agreement between annotators and the first disagreements.

    ``gold`` also has judge_relevance and judge_helpfulness (null without) beside relevance and helpfulness."""
    names = X.annotator_counts(gold)
    own = gold.join(F.broadcast(names.where("primary").select("annotator")), "annotator")
    out = X.calibration_report(gold, total_cases)
    for name in ("relevance", "helpfulness"):
        s = reports.score_calibration(own, f"judge_{name}", name)
        out = out.crossJoin(F.broadcast(s.select(F.when(F.col("pairs") > 0, F.struct(*s.columns)).alias(name))))
    both = X.between_annotators(gold)
    out = out.join(F.broadcast(both.select(F.struct(*both.columns).alias("inter_annotator"))), how="left")
    human = F.col("verdict") == "hallucinated"
    apart = own.where(F.col("judge_bad").isNotNull() & (F.col("verdict") != "unclear") & (human != F.col("judge_bad")))
    first = apart.select(F.when(human, "missed").otherwise("false_alarm").alias("kind"), "case_id").orderBy(F.desc("kind"), "case_id").limit(most)
    listed = first.agg(F.array_sort(F.collect_list(F.struct((F.col("kind") != "missed").alias("later"), "case_id", "kind"))).alias("x"))
    return out.crossJoin(F.broadcast(listed.select(F.transform("x", lambda d: F.struct(d["kind"], d["case_id"])).alias("disagreements"))))


# ---- settings ----
# The defaults of a pipeline.
CHUNKING = {"strategy": "headings", "chunk_size": 500, "overlap": 50, "min_chars": 80}


def settings_error(c: Column, top_k: Column, generation: Column, judge: Column) -> Column:
    """The first thing that is wrong with a pipeline: chunking (a struct), how many to retrieve, generation and judge (structs, null if off).

    What is wrong with a section is named after it, as in ``judge.max_claims``."""
    said = lambda x, n: F.trim(F.coalesce(x[n], F.lit(""))) != ""
    model = lambda x, prompt: {"provider": said(x, "provider"), "model": said(x, "model"), prompt: said(x, prompt), "temperature": x["temperature"].between(0, 2), "max_tokens": x["max_tokens"] > 0, "max_context_chars": x["max_context_chars"] > 0}
    checks = {"strategy": c["strategy"].isin(*STRATEGIES), "chunk_size": c["chunk_size"] > 0, "overlap": (c["overlap"] >= 0) & (c["overlap"] < c["chunk_size"]), "min_chars": c["min_chars"] >= 0, "top_k": top_k <= 50}
    checks |= {f"generation.{n}": generation.isNull() | F.coalesce(ok, F.lit(False)) for n, ok in model(generation, "prompt_id").items()}
    judged = model(judge, "claims_prompt_id") | {"rubric_prompt_id": ~F.coalesce(judge["enable_rubric"], F.lit(True)) | said(judge, "rubric_prompt_id"), "max_claims": judge["max_claims"] > 0}
    checks |= {f"judge.{n}": judge.isNull() | F.coalesce(ok, F.lit(False)) for n, ok in judged.items()}
    return L.first_error(**checks, judge_needs_generation=judge.isNull() | generation.isNotNull())


def object_json(column: Column, fields: dict[str, str]) -> Column:
    """A struct as canonical JSON: ``fields`` by name as text, number or flag."""
    kinds = {"text": P.json_text, "number": P.json_number, "flag": lambda c: c.cast("string")}
    return F.when(column.isNotNull(), P.canonical_json(**{n: kinds[k](column[n]) for n, k in fields.items()}))


CHUNKING_FIELDS = {"strategy": "text", "chunk_size": "number", "overlap": "number", "min_chars": "number"}
EMBEDDING_FIELDS = {"provider": "text", "base_url": "text", "model": "text", "dim": "number", "batch_size": "number"}
GENERATION_FIELDS = {"provider": "text", "base_url": "text", "model": "text", "prompt_id": "text", "temperature": "number", "max_tokens": "number", "max_context_chars": "number"}
JUDGE_FIELDS = {"provider": "text", "base_url": "text", "model": "text", "claims_prompt_id": "text", "rubric_prompt_id": "text", "temperature": "number", "max_tokens": "number", "max_context_chars": "number", "enable_rubric": "flag", "max_claims": "number"}


def previews(requests: DataFrame) -> DataFrame:
    """``requests`` (corpus_id, dataset_id, chunking, embedding, top_k, generation, judge) with what they would be run as: error, config_hash, chunking_hash, collection.

    Missing fields of ``chunking`` are the defaults, ``top_k`` of nothing or less than 1 is 5. A section that is off isn't
    part of the settings, so that runs without it keep their hash."""
    c = F.struct(*(F.coalesce(F.nullif(F.trim(F.col("chunking.strategy")), F.lit("")) if n == "strategy" else F.col(f"chunking.{n}"), F.lit(v)).alias(n) for n, v in CHUNKING.items()))
    k = F.when(F.coalesce("top_k", F.lit(0)) <= 0, 5).otherwise(F.col("top_k"))
    out = requests.withColumn("_c", c).withColumn("_k", k)
    chunking = object_json(F.col("_c"), CHUNKING_FIELDS)
    reranker = F.lit('{"enabled":false}')
    parts = {"chunking": chunking, "data": P.canonical_json(corpus_id=P.json_number(F.col("corpus_id")), dataset_id=P.json_number(F.col("dataset_id"))), "embedding": object_json(F.col("embedding"), EMBEDDING_FIELDS), "extras": F.lit("{}"), "generation": object_json(F.col("generation"), GENERATION_FIELDS), "judge": object_json(F.col("judge"), JUDGE_FIELDS), "retrieval": P.canonical_json(reranker=reranker, top_k=P.json_number(F.col("_k")))}
    pairs = [F.concat(F.lit(f'"{n}":'), v) for n, v in sorted(parts.items())]
    snapshot = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    known = (F.coalesce("corpus_id", F.lit(0)) > 0) & (F.coalesce("dataset_id", F.lit(0)) > 0)
    error = F.when(~known, "no corpus or dataset").otherwise(settings_error(F.col("_c"), F.col("_k"), F.col("generation"), F.col("judge")))
    out = out.withColumn("error", error).withColumn("chunking_hash", P.fingerprint(chunking)).withColumn("config_hash", P.fingerprint(snapshot))
    ok = F.col("error").isNull()
    return out.select(*requests.columns, "error", F.when(ok, F.col("config_hash")).alias("config_hash"), F.when(ok, F.col("chunking_hash")).alias("chunking_hash"), F.when(ok, P.collection_name(F.col("corpus_id"), F.col("chunking_hash"))).alias("collection"), F.col("generation").isNotNull().alias("generation_enabled"), F.col("judge").isNotNull().alias("judge_enabled"))


def case_contexts(results: DataFrame, runs: DataFrame, points: DataFrame) -> DataFrame:
    """(run_id, qid, collection, chunks, error) of results (run_id, qid, retrieved: ranked structs of point_id and score).

    ``runs`` have run_id and collection (null if their settings don't tell it), ``points`` collection, point_id, text and
    section. Chunks come in the order in which they were retrieved, each once; those that aren't there any more, or a
    collection that isn't there at all, leave the text empty and say so."""
    named = results.join(runs.select("run_id", "collection"), "run_id", "left")
    each = named.select("run_id", "qid", "collection", F.posexplode_outer("retrieved").alias("pos", "hit"))
    first = each.groupBy("run_id", "qid", "collection", F.col("hit.point_id").alias("point_id")).agg(F.min("pos").alias("pos"), F.min_by("hit.score", "pos").alias("score"))
    have = points.select("collection").distinct().withColumn("_there", F.lit(True))
    met = first.join(points, ["collection", "point_id"], "left").join(F.broadcast(have), "collection", "left")
    chunk = F.struct("pos", "point_id", "score", "text", "section", F.col("text").isNotNull().alias("found"))
    out = met.groupBy("run_id", "qid", "collection").agg(F.array_sort(F.collect_list(F.when(F.col("point_id").isNotNull(), chunk))).alias("chunks"), F.max("_there").alias("_there"))
    error = F.when(F.col("collection").isNull(), "no collection in the settings").when(F.col("_there").isNull(), "no such collection").when(F.exists("chunks", lambda c: ~c["found"]), "chunks missing")
    return out.select("run_id", "qid", "collection", "chunks", error.alias("error"))
