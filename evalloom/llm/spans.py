"""Span lists as columns: what the scanning operators return, and digests of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def ordered(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """Spans by start, then kind as ``kinds`` lists them, then end; each once."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digest_columns(found: DataFrame, spans: str, base_kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, a count for each base kind, the base spans' digest and all spans."""
    base = of_kinds(F.col(spans), base_kinds)
    counts = [F.size(of_kinds(F.col(spans), (k,))).cast("long").alias(f"n_{k}") for k in base_kinds]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))
