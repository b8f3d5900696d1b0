"""Cases imported from lines of JSON: what is wrong with each line, and how many are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.listing import DIFFICULTIES
from evalloom.operators.passages import stripped

#: Bytes of a line from which it isn't read.
LINE_BYTES = 2 << 20
SCHEMA = "qid string, question string, gold_anchors string, reference_answer string, category string, difficulty string, notes string"
ANCHORS = "array<struct<doc:string,span:string>>"


def parsed(lines: DataFrame) -> DataFrame:
    """(file, line, fields, errors): lines that aren't blank, with everything that is wrong with their form.

    ``errors`` are in the order in which they are looked for; a line that can't be read has one."""
    value = stripped(F.col("value"))
    some = lines.where(value != "").withColumn("value", value)
    long = F.octet_length("value") > LINE_BYTES
    row = F.from_json(F.when(~long, F.col("value")), SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    read = some.select(*[c for c in some.columns if c != "value"], long.alias("_long"), F.substring("value", 1, 1).alias("_first"), row.alias("r"))
    text = lambda c: stripped(F.coalesce(F.col(f"r.{c}"), F.lit("")))
    read = read.withColumn("qid", text("qid")).withColumn("question", text("question")).withColumn("anchors", F.from_json("r.gold_anchors", ANCHORS))
    given = F.coalesce(F.col("r.gold_anchors"), F.lit("null")) != "null"
    nameless = F.filter(F.transform("anchors", lambda a, i: F.when(stripped(F.coalesce(a["doc"], F.lit(""))) == "", i)), lambda i: i.isNotNull())
    difficulty = F.coalesce(F.col("r.difficulty"), F.lit(""))
    form = [
        F.when(F.col("qid") == "", "no qid"),
        F.when(F.col("question") == "", "no question"),
        F.when((difficulty != "") & ~difficulty.isin(*DIFFICULTIES), "bad difficulty"),
        F.when(given & ~F.col("r.gold_anchors").startswith("["), "anchors aren't a list"),
        F.when(F.size(nameless) > 0, F.concat(F.lit("anchor without doc: "), F.array_join(nameless, ","))),
    ]
    unread = F.when(F.col("_long"), "line too long").when(F.col("r._bad").isNotNull() | (F.col("_first") != "{"), "no JSON object")
    errors = F.when(unread.isNotNull(), F.array(unread)).otherwise(F.filter(F.array(*form), lambda e: e.isNotNull()))
    kept = [F.nullif(text(c), F.lit("")).alias(c) for c in ("reference_answer", "category", "difficulty", "notes")]
    return read.select(*[c for c in some.columns if c != "value"], F.when(unread.isNull(), F.col("qid")).alias("qid"), F.when(unread.isNull(), F.col("question")).alias("question"), "anchors", *kept, errors.alias("errors"))


def checked(cases: DataFrame, stored: DataFrame, docs: DataFrame) -> DataFrame:
    """``parsed`` cases with what the store says added to ``errors``: a qid that is stored, one that an earlier good line has, anchors of unknown documents (``doc``).

    Only lines without errors take a qid: the first of several in the order of file and line."""
    known = stored.select("qid", F.lit(True).alias("_stored")).distinct()
    each = cases.where(F.size("errors") == 0).select("file", "line", F.posexplode("anchors").alias("nth", "a")).select("file", "line", "nth", F.col("a.doc").alias("doc"))
    lost = each.join(docs.select("doc").distinct(), "doc", "left_anti").groupBy("file", "line").agg(F.min_by("doc", "nth").alias("_lost"))
    out = cases.join(known, "qid", "left").join(lost, ["file", "line"], "left")
    fine = (F.size("errors") == 0) & F.col("_stored").isNull()
    first = out.where(fine & F.col("_lost").isNull()).groupBy("qid").agg(F.min(F.struct("file", "line")).alias("_first"))
    out = out.join(first, "qid", "left")
    wrong = [F.when(F.col("_stored"), "stored qid"), F.when(F.struct("file", "line") > F.col("_first"), "repeated qid"), F.when(F.col("_lost").isNotNull(), F.concat(F.lit("no such document: "), "_lost"))]
    told = F.filter(F.array(*wrong), lambda e: e.isNotNull())
    return out.withColumn("errors", F.when(F.size("errors") == 0, told).otherwise(F.col("errors"))).select(*cases.columns)


def totals(checked_cases: DataFrame) -> DataFrame:
    """A row for each file: lines that count, those imported, those refused."""
    good = F.size("errors") == 0
    return checked_cases.groupBy("file").agg(F.count("*").alias("total"), F.count_if(good).alias("imported"), F.count_if(~good).alias("refused"))


def refused(checked_cases: DataFrame) -> DataFrame:
    """(file, line, qid, error), one for each thing that is wrong."""
    return checked_cases.select("file", "line", "qid", F.explode("errors").alias("error"))


def first_error(errors: Column) -> Column:
    return F.get(errors, F.lit(0))
