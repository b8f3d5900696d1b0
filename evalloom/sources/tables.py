"""Readers: tables by name, JSON lines with their numbers, documents with a front-matter header."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(lines: DataFrame, schema: str, number: str = "line", text: str = "value") -> DataFrame:
    """Each non-blank line parsed, with ``error`` set where it isn't an object of the schema."""
    kept = lines.where(~F.col(text).rlike(r"(?U)^\s*$"))
    parsed = kept.withColumn("row", F.from_json(text, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select(number, "row.*").withColumn("error", F.when(F.col("_corrupt").isNotNull(), F.lit("invalid JSON"))).drop("_corrupt")


def front_matter(files: DataFrame, text: str = "value") -> DataFrame:
    """doc_id, title, module, tags, version and body of documents that begin with a header between lines of three dashes.

    Tags are what stands between commas, in brackets or not, without quotation marks."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    field = lambda name: F.nullif(F.regexp_extract(head, rf"(?m)^{name}:\s*(.*?)\s*$", 1), F.lit(""))
    listed = F.transform(F.split(F.regexp_replace(F.coalesce(field("tags"), F.lit("")), r"^\[|\]$", ""), ","), lambda t: F.regexp_replace(t, r"""^[\s"']+|[\s"']+$""", ""))
    tags = F.filter(listed, lambda t: t != "").alias("tags")
    return files.select(*(field(n).alias(n) for n in ("doc_id", "title", "module", "version")), tags, F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "").alias("raw_text"))


def numbered_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, line, value) of text files: each line with its number in its file, from 1. With ``parts``, the files of a folder are parts of one, in the order of their names, and the folder is the file.

    A file is read in splits. Lines are counted by split, a window adds up the splits before (a row a split), and tasks
    count on from there: neither a file's lines nor a whole file go through one task, and lines aren't dealt. Lines end at line feeds; a
    carriage return before one isn't part of the line."""
    raw = spark.read.option("lineSep", "\n").text(path)
    at = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")
    file = F.regexp_replace("path", "/[^/]*$", "") if parts else F.col("path")
    sizes = at.groupBy("path", "split").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(file).orderBy("path", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    schema = T.StructType([*at.schema.fields, T.StructField("nth", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a split come one after another
        now, n = None, 0
        for batch in batches:
            nth = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = n + 1 if key == now else 1
                now = key
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], names=schema.names)

    lines = at.mapInArrow(count, schema).join(F.broadcast(sizes.select("path", "split", before.alias("before"))), ["path", "split"])
    return lines.select(file.alias("file"), (F.col("before") + F.col("nth")).alias("line"), F.regexp_replace("value", r"\r$", "").alias("value"))
