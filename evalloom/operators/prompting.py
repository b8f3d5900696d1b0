"""Prompts and fingerprints: canonical JSON, hashes, contexts, templates, protocols, indexes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.scoring import point_id, rounded
from evalloom.operators.passages import anchored, extract_object, stripped

# The placeholders that a template may have, and the text that stands for no context.
PLACEHOLDERS = ("contexts", "question", "answer", "reference_answer", "claims_summary")
NO_CONTEXT = "（无检索结果）"
SECTION = re.compile(r"^\[(system|user)\]\s*$", re.MULTILINE)


def json_text(column: Column) -> Column:
    """A text as JSON; null stays null."""
    listed = F.to_json(F.array(column))
    return F.when(column.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def json_number(column: Column) -> Column:
    """A number as JSON, without a fraction if it's whole."""
    column = column.cast("double")
    return F.when(column == F.floor(column), column.cast("long").cast("string")).otherwise(column.cast("string"))


def canonical_json(**parts: Column) -> Column:
    """An object of JSON texts in the order of their keys, without spaces; nulls are written."""
    pairs = [F.concat(F.lit(f'"{k}":'), F.coalesce(parts[k], F.lit("null"))) for k in sorted(parts)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def fingerprint(canonical: Column, digits: int = 64) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, digits)


def prompt_hash(system: Column, user: Column) -> Column:
    return fingerprint(canonical_json(system=json_text(stripped(system)), user=json_text(stripped(user))), 16)


def cache_key(stage: str, prompt: Column, model: Column, payload: Column) -> Column:
    """The key of a judgement; ``payload`` is canonical JSON."""
    return fingerprint(canonical_json(stage=json_text(F.lit(stage)), prompt_hash=json_text(prompt), model=json_text(model), payload=payload))


def collection_name(corpus: Column, chunking_hash: Column) -> Column:
    return F.concat(F.lit("corpus"), corpus.cast("string"), F.lit("_"), F.substring(chunking_hash, 1, 8))


def split_template(raw: str) -> dict[str, str]:
    """The sections of a template by name; what stands before the first marker is a comment."""
    marks = list(SECTION.finditer(raw))
    return {m[1]: raw[m.end() : after.start() if after else len(raw)] for m, after in zip(marks, [*marks, None][1:], strict=True)}


def checked_placeholders(template: str, required: tuple[str, ...]) -> list[str]:
    """The placeholders that a template uses. Unknown ones are an error, as are required ones that it lacks."""
    used = list(dict.fromkeys(re.findall(r"\{([a-zA-Z_]\w*)\}", template, re.ASCII)))
    if unknown := sorted(set(used) - set(PLACEHOLDERS)):
        raise ValueError(f"unknown placeholders: {unknown}")
    if missing := [name for name in required if name not in used]:
        raise ValueError(f"the template lacks: {missing}")
    return used


def rendered(template: str, required: tuple[str, ...] = ("contexts", "question"), **values: Column) -> Column:
    """A template with its placeholders replaced in one pass; braces around anything but a name stay.

    A value that the template doesn't use is an error, and so is a required one that isn't given."""
    used = checked_placeholders(template, required)
    if unknown := sorted(set(values) - set(used)):
        raise ValueError(f"not in the template: {unknown}")
    if missing := [name for name in required if name not in values]:
        raise ValueError(f"no value for: {missing}")
    parts = re.split("({(?:" + "|".join(PLACEHOLDERS) + ")})", template)
    return F.concat(*(values[p[1:-1]] if p[1:-1] in values and p[:1] == "{" else F.lit(p) for p in parts))


def context_bundle(hits: Column, budget: int) -> Column:
    """(text, chunks, chars, dropped) of ranked (doc_id, text) hits: each with its rank and document before it, whole or not at all."""
    blocks = F.transform(hits, lambda h, i: F.struct(stripped(F.coalesce(h["text"], F.lit(""))).alias("body"), F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), F.when(F.coalesce(h["doc_id"].cast("string"), F.lit("")) != "", F.concat(F.lit(" ("), h["doc_id"].cast("string"), F.lit(")"))).otherwise(""), F.lit("\n")).alias("head")))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"))

    def add(state: Column, block: Column) -> Column:
        cost = F.length(block["head"]) + F.length(block["body"]) + F.when(F.size(state["parts"]) > 0, 2).otherwise(0)
        fits = (block["body"] != "") & (state["used"] + cost <= budget)
        return F.when(fits, F.struct(F.concat(state["parts"], F.array(F.concat(block["head"], block["body"]))).alias("parts"), (state["used"] + cost).alias("used"))).otherwise(state)

    def finish(state: Column) -> Column:
        text = F.when(F.size(state["parts"]) > 0, F.array_join(state["parts"], "\n\n")).otherwise(NO_CONTEXT)
        return F.struct(text.alias("text"), F.size(state["parts"]).alias("chunks"), F.length(text).alias("chars"), (F.size(hits) - F.size(state["parts"])).alias("dropped"))

    return F.aggregate(blocks, start, add, finish)


def rubrics(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """``answers`` with relevance and helpfulness, or an error where they aren't whole numbers of 1 to 5."""
    parsed = answers.withColumn("_r", F.from_json(extract_object(F.col(answer)), "relevance double, helpfulness double, reason string"))
    good = lambda c: F.coalesce(c.between(1, 5) & (c == F.floor(c)), F.lit(False))
    ok = good(F.col("_r.relevance")) & good(F.col("_r.helpfulness"))
    value = lambda c: F.when(ok, F.col(f"_r.{c}").cast("int")).alias(c)
    return parsed.select(*answers.columns, value("relevance"), value("helpfulness"), F.when(~ok, "bad rubric").alias("error"))


def mapped(anchors: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc, span, points, level, failure) of each anchor (qid, doc, span): the chunks that hold it, or why there are none."""
    found = anchored(anchors, chunks).groupBy("qid", "doc", "span").agg(F.collect_set("point").alias("points"), F.min("level").alias("level"))
    known = docs.select("doc", F.lit(True).alias("_doc")).distinct()
    some = chunks.select("doc", F.lit(True).alias("_chunks")).distinct()
    out = anchors.join(known, "doc", "left").join(some, "doc", "left").join(found, ["qid", "doc", "span"], "left")
    failure = F.when(F.col("points").isNotNull(), F.lit(None)).when(F.col("_doc").isNull(), "no document").when(F.col("_chunks").isNull(), "no chunks").otherwise("no match")
    return out.select("qid", "doc", "span", F.coalesce("points", F.array().cast("array<string>")).alias("points"), "level", failure.alias("failure"))


def case_gold(mapped_anchors: DataFrame) -> DataFrame:
    """(qid, gold, failures): the union of a case's chunks, and how many of its anchors failed; a case is mapped if it has any gold."""
    return mapped_anchors.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("points"))).alias("gold"), F.count("failure").alias("failures"))


def coverage(cases: DataFrame, least: float = 0.0) -> DataFrame:
    """One row from ``case_gold``: cases, those with gold, their share, gold chunks each, and whether the share is enough."""
    n = F.size("gold")
    out = cases.agg(F.count("*").alias("cases"), F.count_if(n > 0).alias("mapped"), F.coalesce(F.round(F.avg(F.when(n > 0, n)), 2), F.lit(0.0)).alias("avg_gold_chunks"))
    share = F.when(F.col("cases") > 0, F.col("mapped") / F.col("cases")).otherwise(0.0)
    return out.withColumn("coverage", rounded(share, 4)).withColumn("enough", share >= least)


def anchor_diagnostics(mapped_anchors: DataFrame, chunks: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """(kind, value, n): histograms of gold chunks a case and matches an anchor, anchors that match every chunk of their document, and, of ``cases`` (qid), how many ids come how often, if more than once."""
    sizes = chunks.groupBy("doc").agg(F.count("*").alias("chunks"))
    matches = F.size("points").cast("long")
    every = mapped_anchors.join(sizes, "doc").where((F.col("chunks") > 1) & (matches == F.col("chunks")))
    row = lambda df, kind, value: df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    out = row(case_gold(mapped_anchors), "gold", F.size("gold").cast("long")).unionByName(row(mapped_anchors, "matches", matches)).unionByName(row(every, "every chunk", F.col("chunks")))
    if cases is None:
        return out
    times = cases.groupBy("qid").agg(F.count("*").alias("times")).where("times > 1")
    return out.unionByName(row(times, "repeated id", F.col("times")))


def index_points(chunks: DataFrame, corpus: int, chunking_hash: str, namespace: str) -> DataFrame:
    """Chunks (doc, index, text, ...) as points with ids that are the same whenever they are made again."""
    name = F.concat_ws(":", F.lit(str(corpus)), F.col("doc").cast("string"), F.col("index").cast("string"), F.lit(chunking_hash))
    return chunks.withColumn("point_id", point_id(namespace, name)).withColumn("collection", collection_name(F.lit(corpus), F.lit(chunking_hash)))


def index_report(docs: DataFrame, points: DataFrame, batch: int = 16) -> DataFrame:
    """One row: documents, chunks, distinct points, calls and characters that embedding them takes."""
    n = points.agg(F.count("*").alias("chunks"), F.count_distinct("point_id").alias("points"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return docs.agg(F.count("*").alias("docs")).join(n, F.lit(True)).withColumn("calls", F.ceil(F.col("chunks") / batch))


def csv_line(*cells: Column) -> Column:
    from evalloom.functions.scoring import csv_cell

    return F.concat_ws(",", *(F.coalesce(csv_cell(c.cast("string")), F.lit("")) for c in cells))


def csv_block(rows: DataFrame, title: list[str], cells: list[str], order: list[Column | str]) -> DataFrame:
    """(block line by line) a head and a line for each row, numbered in their order."""
    from pyspark.sql import Window

    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("line"), csv_line(*map(F.lit, title)).alias("text"))
    body = rows.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("line"), csv_line(*map(F.col, cells)).alias("text"))
    return head.unionByName(body)


def markdown_table(rows: DataFrame, title: list[str], cells: list[str], order: list[Column | str]) -> DataFrame:
    """(line, text): a table in Markdown with pipes escaped. For reports, whose rows are few."""
    from pyspark.sql import Window

    join = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("|"), F.lit("\\|"))
    head = rows.sparkSession.range(2).select(F.col("id").alias("line"), F.when(F.col("id") == 0, join([F.lit(t) for t in title])).otherwise("|" + " --- |" * len(title)).alias("text"))
    body = rows.select((F.row_number().over(Window.orderBy(*order)) + 1).cast("long").alias("line"), join([cell(c) for c in cells]).alias("text"))
    return head.unionByName(body)
