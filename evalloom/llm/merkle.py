"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of them, by DataFrame functions alone.

Two line ends in a row end a section, one ends a paragraph, and a paragraph's leaves are its runs of ``PIECE``
code points. The root is the SHA-256 of its sections' SHA-256s, and these of their paragraphs', so that equal
roots mean equal texts. Leaves are 64-bit hashes, and the nodes between, by which trees are compared, hashes of
theirs. The fingerprint is the root and the leaves, ``/`` after a paragraph and ``;`` after a section, so that it
holds the whole tree. Where two trees differ, ``differing`` goes down the branches whose hashes differ to the
places that were edited, and ``edited_paragraphs`` counts paragraphs that are new wherever they stand.

Likeness of two fingerprints: twice the number of leaves they share over the sum of their different leaves.

Defined cases: a null text is empty; an empty text has a root and no leaves, and is like another empty one at
1 and like any other at 0; rows that repeat an id, and null ids, which come last in descending order, follow one
another by hashes; the only row is its own next one; ids may be of any type with an order that JSON can write; a
text of any length is hashed whole; an empty table gives an empty result; other columns are kept, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm.common import text_frame

PIECE = 32
#: Text that one range of ids should hold; beyond so many ranges both their number and what each holds grow, as the root of the text.
RANGE_BYTES = 8 << 20
RANGES = 4096
#: Ids that are looked at for each range, to set the ranges' bounds.
SAMPLES = 16


def tree(text: Column, piece: int = PIECE) -> Column:
    """Leaves by paragraph and section: array<array<array<long>>>. Empty paragraphs have no leaves."""
    cut = rf"(?s).{{1,{piece}}}"
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(cut), F.lit(0)), lambda x: F.xxhash64(x))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda s: F.transform(F.split(s, "\n"), paragraph))


def section_hashes(leaves: Column) -> Column:
    return F.transform(leaves, lambda s: F.xxhash64(F.transform(s, lambda p: F.xxhash64(p))))


def root(text: Column) -> Column:
    """The SHA-256 of the sections' SHA-256s, each that of its paragraphs'."""
    section = lambda s: F.sha2(F.array_join(F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)), ","), 256)
    return F.sha2(F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section), ";"), 256)


def fingerprint(text: Column, leaves: Column) -> Column:
    """The root, a colon and the leaves in hexadecimal."""
    paragraph = lambda p: F.array_join(F.transform(p, lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.concat(root(text), F.lit(":"), F.array_join(F.transform(leaves, lambda s: F.array_join(F.transform(s, paragraph), "/")), ";"))


def all_leaves(leaves: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(leaves)))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of different leaves."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing(a: Column, b: Column) -> Column:
    """The (section, paragraph) places, from 0, whose branches differ in two trees; a place that one of them lacks differs."""

    def in_section(pair: Column, at: Column) -> Column:
        left, right = F.coalesce(pair["0"], F.array().cast("array<array<bigint>>")), F.coalesce(pair["1"], F.array().cast("array<array<bigint>>"))
        marked = F.transform(F.arrays_zip(left.alias("0"), right.alias("1")), lambda x, i: F.struct(at.alias("section"), i.alias("paragraph"), (~x["0"].eqNullSafe(x["1"])).alias("differs")))
        return F.when(F.xxhash64(left) == F.xxhash64(right), F.filter(marked, lambda x: F.lit(False))).otherwise(F.filter(marked, lambda x: x["differs"]))

    return F.transform(F.flatten(F.transform(F.arrays_zip(a.alias("0"), b.alias("1")), in_section)), lambda x: F.struct(x["section"], x["paragraph"]))


def edited_paragraphs(a: Column, b: Column) -> Column:
    """How many paragraphs of the second tree the first one lacks: of branches whose hashes differ, by the hashes of theirs.

    An inserted paragraph counts as one, wherever it stands."""
    changed = F.array_except(hashed_sections(b), hashed_sections(a))
    return F.size(F.array_except(F.flatten(F.transform(changed, lambda s: s["paragraphs"])), F.flatten(F.transform(hashed_sections(a), lambda s: s["paragraphs"]))))


def hashed_sections(leaves: Column) -> Column:
    return F.transform(leaves, lambda s: F.struct(F.xxhash64(s).alias("h"), F.transform(s, lambda p: F.xxhash64(p)).alias("paragraphs")))


def fingerprints(docs: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with each text's fingerprint; a column of that name is replaced."""
    return docs.withColumn(into, fingerprint(F.col(text_col), tree(F.col(text_col))))


def bounds_of(ids: DataFrame, n: int, ranges: int) -> str:
    """ranges - 1 ids in descending order as a JSON array of arrays of about equal length; a frequent id is there several times.

    They are quantiles of a sample that is as large as the number of ranges asks for."""
    some = ids.where("id is not null").sample(min(1.0, SAMPLES * ranges / max(1, n)), seed=7).agg(F.sort_array(F.collect_list("id"), asc=False).alias("s"))
    cut = F.when(F.size("s") > 0, F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / ranges).cast("int"))))
    block = max(1, math.isqrt(ranges - 1))
    blocks = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1), F.lit(block)), lambda i: F.slice(cut, i, block))
    return some.select(F.to_json(blocks).alias("b")).first()["b"] or "[]"


def range_of(key: Column, h: Column, bounds: str, kind: str) -> Column:
    """How many bounds are greater than a key; rows with a key that is there several times are spread over as many ranges, by ``h`` in descending order."""
    blocks = F.from_json(F.lit(bounds), f"array<array<{kind}>>")

    def count(beyond: Callable[[Column], Column]) -> Column:
        whole = F.size(F.filter(blocks, lambda b: beyond(F.element_at(b, -1))))
        width = F.when(F.size(blocks) > 0, F.size(F.element_at(blocks, 1))).otherwise(0)
        return whole * width + F.coalesce(F.size(F.filter(F.get(blocks, whole), beyond)), F.lit(0))

    greater, equal = count(lambda b: b > key), count(lambda b: b >= key)
    spread = F.floor((F.lit(2.0**63) - h) / 2.0**64 * (equal - greater)).cast("int")
    return greater + F.least(spread, F.greatest(equal - greater - 1, F.lit(0)))


def with_next(docs: DataFrame, id_col: str, text_col: str, carried: list[Column]) -> DataFrame:
    """id, text and the carried columns of each row, and those of the next document (in a struct ``next``) by descending id; the first follows the last.

    Documents are dealt once, by ranges of ids; a range's last row finds its successor in a copy of the next
    range's first row, so that copies are one for each range. Repeated ids, and null ones, which come last, are
    in the order of hashes, and spread over several ranges if they are frequent. ``docs`` is read several times,
    and has to give the same rows in the same order each time, as a table does.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text", F.monotonically_increasing_id()))
    size, n, known = own.agg(F.sum(F.octet_length("text")), F.count("*"), F.count("id")).first()
    ranges = max(1, -(-(size or 0) // RANGE_BYTES))
    ranges = min(ranges, math.isqrt(ranges * RANGES))
    ids = ranges * known // max(1, n)
    at = range_of(F.col("id"), F.col("h"), bounds_of(own.select("id"), known, ids), kind) if ids > 1 else F.lit(0)
    of_nulls = max(1, ranges - ids)
    unknown = F.lit(max(1, ids)) + F.least(F.floor((F.lit(2.0**63) - F.col("h")) / 2.0**64 * of_nulls).cast("int"), F.lit(of_nulls - 1))
    own = own.withColumn("range_no", F.when(F.col("id").isNull(), unknown).otherwise(at))
    first = own.groupBy("range_no").agg(F.max(F.struct("id", "h")).alias("x")).select("range_no", "x.*")
    # one row for each range
    after = first.select("id", "h", F.lag("range_no").over(Window.partitionBy().orderBy("range_no")).alias("before"), F.max("range_no").over(Window.partitionBy()).alias("last"))
    ids = after.select(F.col("id").alias("first_id"), F.col("h").alias("first_h"), F.coalesce("before", "last").alias("goes_to"))
    copies = own.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    copies = copies.select("id", "text", "h", F.col("goes_to").alias("range_no"), F.lit(1).alias("copy"))
    both = own.withColumn("copy", F.lit(0)).unionByName(copies)
    order = Window.partitionBy("range_no").orderBy("copy", F.col("id").desc_nulls_last(), F.col("h").desc())
    whole = both.select("*", *carried)
    names = ["text", *[c for c in whole.columns if c not in both.columns]]
    return whole.withColumn("next", F.lead(F.struct(*names)).over(order)).where("copy = 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_frame(spark, sf_dir, "doc_id", "text")
    rows = with_next(docs, "doc_id", "text", [tree(F.col("text")).alias("leaves")])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select(F.col("id").alias("doc_id"), n.cast("long").alias("n_chars"), "text", "leaves", F.col("next.leaves").alias("next_leaves"), edited.alias("edited"))
    rows = rows.withColumn("edited_leaves", tree(F.col("edited")))
    own, other, after = (all_leaves(F.col(c)) for c in ("leaves", "edited_leaves", "next_leaves"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text"), F.col("leaves")).alias("fingerprint"), fingerprint(F.col("edited"), F.col("edited_leaves")).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"), edited_paragraphs(F.col("leaves"), F.col("edited_leaves")).cast("long").alias("n_edited_paragraphs"))
