"""Filters, lookups, orders and joins of runs, cases, annotations and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of annotations: those nobody has looked at first.
STATUS_ORDER = (None, "open", "fixed", "verified", "wontfix")


def clamped(limit: int, default: int, most: int) -> int:
    """A limit out of range is the default, not the largest one."""
    return limit if 0 < limit <= most else default


def equal_if_given(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows equal to each value given; None, 0 and '' are no filter."""
    for name, value in wanted.items():
        if value not in (None, 0, ""):
            df = df.where(F.col(name) == value)
    return df


def newest(df: DataFrame, limit: int, default: int = 50, most: int = 200, by: str = "id") -> DataFrame:
    return df.orderBy(F.desc(by)).limit(clamped(limit, default, most))


def one(df: DataFrame, **key: object) -> DataFrame:
    """The row with a key, none if there is no such row. Every value counts, 0, '' and None too."""
    for name, value in key.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df.limit(1)


def flagged(df: DataFrame, only: bool = True) -> DataFrame:
    return df.where(F.size("flags") > 0) if only else df


def with_flag(df: DataFrame, flag: str) -> DataFrame:
    return df.where(F.array_contains("flags", flag))


def annotated(cases: DataFrame, annotations: DataFrame, key: str = "case_id") -> DataFrame:
    """All cases with their annotation, if any, and ``todo``: 0 for those without, then by status, 5 for an unknown one."""
    both = cases.join(annotations, key, "left")
    todo = F.lit(len(STATUS_ORDER))
    for i, status in enumerate(STATUS_ORDER):
        todo = F.when(F.col("status").eqNullSafe(status), i).otherwise(todo)
    return both.withColumn("todo", todo.cast("long"))


def pending_first(rows: DataFrame, then: str) -> DataFrame:
    return rows.orderBy("todo", then)


def still_open(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status").isNull() | (F.col("status") == "open"))


def unscored(cases: DataFrame, gold: DataFrame, annotator: str, key: str = "case_id") -> DataFrame:
    """Cases that the annotator hasn't scored."""
    return cases.join(gold.where(F.col("annotator") == annotator), key, "left_anti")


def candidates(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """The runs that a baseline (one row) may be compared with: succeeded ones, those of its dataset first."""
    base = baseline.select(F.col("id").alias("_id"), F.col("dataset_id").alias("_dataset"), F.col("config_hash").alias("_hash")).limit(1)
    met = runs.where(F.col("status") == "succeeded").join(F.broadcast(base), F.col("id") != F.col("_id"))
    same = F.col("dataset_id") == F.col("_dataset")
    return met.select("id", same.alias("same_dataset"), (F.col("config_hash") == F.col("_hash")).alias("same_config")).orderBy(F.desc("same_dataset"), "id")


def latest(df: DataFrame, by: str, order: str = "id") -> DataFrame:
    """The row with the largest ``order`` for each ``by``."""
    return df.groupBy(by).agg(F.max_by(F.struct(*df.columns), order).alias("x")).select("x.*")


def first_each(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def looked_up_points(retrieved: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Retrieved ids, each once by its first rank, with the point's columns and whether there is one."""
    first = first_each(retrieved, ["qid", key], ["rank"])
    return first.join(points.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def first_missing(anchors: DataFrame, docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(qid, position, doc) of each case's first anchor whose document doesn't exist."""
    lost = anchors.join(docs.select(doc), doc, "left_anti")
    return lost.groupBy("qid").agg(F.min(F.struct("position", doc)).alias("x")).select("qid", "x.*")


def counted_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    n = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias("n"))
    return parents.join(n, parent_key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def updated(rows: DataFrame, news: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with a column's new values where there are any."""
    return rows.join(news.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def inserted(new: DataFrame, stored: DataFrame, key: str, required: list[str]) -> DataFrame:
    """``new`` with ``error``: a blank field, a key that comes twice in it, or one that is stored. Nothing is to be written unless all are null."""
    blank = F.lit(None).cast("string")
    for name in reversed(required):
        blank = F.when(F.coalesce(F.trim(name), F.lit("")) == "", f"blank {name}").otherwise(blank)
    times = F.count("*").over(Window.partitionBy(key))
    known = stored.select(key).distinct().withColumn("_stored", F.lit(True))
    out = new.withColumn("_times", times).join(known, key, "left")
    error = F.coalesce(blank, F.when(F.col("_times") > 1, f"repeated {key}"), F.when(F.col("_stored"), f"stored {key}"))
    return out.withColumn("error", error).drop("_times", "_stored")


def same_project(pairs: DataFrame, datasets: DataFrame, corpora: DataFrame) -> DataFrame:
    """(dataset_id, corpus_id) with what keeps them from being used together."""
    met = pairs.join(datasets.select("dataset_id", F.col("project_id").alias("_d")), "dataset_id", "left").join(corpora.select("corpus_id", F.col("project_id").alias("_c")), "corpus_id", "left")
    error = F.when(F.col("_d").isNull(), "no dataset").when(F.col("_c").isNull(), "no corpus").when(F.col("_d") != F.col("_c"), "other project")
    return met.withColumn("error", error).drop("_d", "_c")


def canonical_email(column: Column) -> Column:
    return F.lower(F.trim(column))


# What may be stored.
DIFFICULTIES = ("易", "中", "难")
VERDICTS = ("faithful", "hallucinated", "unclear")
REASON_FAMILIES = ("", "retrieval", "hallucination", "generation", "dataset", "unknown")


def first_error(**checks: Column) -> Column:
    """The name of the first check that a row fails; null if it passes all. A check that is null fails."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def in_range(column: Column, least: int, most: int) -> Column:
    """Null is allowed."""
    return column.isNull() | column.between(least, most)


def resolved_top_k(column: Column, default: int = 5, most: int = 50) -> Column:
    """Nothing or less than 1 is the default; null beyond the most."""
    return F.when(F.coalesce(column, F.lit(0)) <= 0, default).when(column <= most, column)


def or_default(sent: Column, default: object, text: bool = True) -> Column:
    """What was sent, or the default: blank text counts as not sent, an explicit 0 or false as sent."""
    return F.coalesce(F.nullif(F.trim(sent), F.lit("")) if text else sent, F.lit(default))
