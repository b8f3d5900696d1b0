"""Near-duplicates by circulant MinHash, banding, exact verification and connected components.

A document's set is its distinct shingles of ``words`` words. One permutation (a hash) gives each shingle its
place among ``PLACES``; a second permutation, shifted by k places, gives coordinate k of the signature: the
least of its values over the set. ``bands`` bands of ``rows`` coordinates bring candidates together.

Documents with equal sets are one class and go on as one. In each bucket of a band every class is compared
with the bucket's first class; sizes rule out pairs that can't link. Links that hold on the full sets give
components. Buckets whose classes then are in one component are done: another comparison there can't change
the result. In the others all classes outside the largest component are compared with those of other
components, in blocks; parity bits of the sets, which bound their difference from below, rule out most pairs
before their sets are fetched. Nothing that banding brought together is left out. What banding itself can
miss: a pair at similarity 0.8 shares none of 32 bands of 5 rows with a probability of about 3e-6.

Defined cases: null texts, empty ones and texts without words have the empty set, size 0, and are linked with
nothing; repeated rows are equal sets; a null id names a component only if all ids in it are null; several
rows with the id that names their component are all ``kept``, but ``chosen`` is one row of each component;
an empty table gives an empty result; texts of any length have all their shingles; other columns are kept,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm import common
from evalloom.llm.common import FREQUENT, HASH, LEAST_FREQUENT, ascii_lower, discard, looked_up, materialise, mix, sliced, slices, text_frame, utf8
from evalloom.llm.components import components
from evalloom.llm.word_tokens import give_back

BANDS, ROWS = 32, 5
PLACE_BITS = 20
PLACES = 1 << PLACE_BITS
PARITY_BITS = 1024
#: Shingles whose coordinates are made at once.
STEP = 8192
#: Ids (8 bytes each) up to which a list of them is broadcast.
FEW_IDS = 2_000_000
FEW_PAIRS = 1_000_000
#: First bits of a band key by which frequent ones are looked for.
FIRST_BITS = 15
#: Classes of a bucket that are compared as one block.
BLOCK = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, sorted by both."""
    start, end, row = common.words(data, offsets)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = ascii_lower(data)
    word = HASH.ranges(HASH.prefix(low), start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    left = first[row + 1] - np.arange(len(row))
    shingle = np.zeros(len(row), np.uint64)
    for k in range(words):
        more = left > k
        at = np.flatnonzero(more) + k
        shingle[more] = mix(shingle[more] * np.uint64(0x9E3779B97F4A7C15) + word[at] + np.uint64(1))
    # full windows; in a row with fewer words, the whole sequence
    keep = (left >= words) | ((count[row] < words) & (first[row] == np.arange(len(row))))
    row, shingle = row[keep], shingle[keep]
    order = np.argsort(shingle)
    order = order[np.argsort(row[order], kind="stable")]
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return row[new], shingle[new]


class Circulant:
    """Signatures from two permutations, the second shifted circularly."""

    def __init__(self, size: int) -> None:
        values = np.random.default_rng(2).permutation(PLACES).astype(np.uint32)
        self.size = size
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:size]]), size)

    def signatures(self, row: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
        place = (shingle >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        out = np.full((n, self.size), np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(row), STEP):
            own = row[i : i + STEP]
            start = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            least = np.minimum.reduceat(self.shifted[place[i : i + STEP]], start, axis=0)
            out[own[start]] = np.minimum(out[own[start]], least)
        return out


def parity(row: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """For each row, whether the shingles that fall on each of ``PARITY_BITS`` places are odd in number; 64 places a word.

    Two sets differ in at least as many members as their words differ in bits.
    """
    place = ((shingle >> np.uint64(8)) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = np.bincount(row * PARITY_BITS + place, minlength=n * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, PARITY_BITS), axis=1, bitorder="little").view(np.int64)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2])
    for k in range(rows):
        key = mix(key ^ (parts[:, :, k] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return key


FEATURES = [T.StructField("n_shingles", T.LongType()), T.StructField("set_sha", T.BinaryType()), T.StructField("band_keys", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType()))]
ARROW_FEATURES = pa.schema([("n_shingles", pa.int64()), ("set_sha", pa.binary()), ("band_keys", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])


def features(texts: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(row_no, id, text) to each row's number, id, set size, the SHA-256 of its whole sorted set, its band keys and its parity bits."""
    kept: list[Circulant] = []

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        if not kept:
            kept.append(Circulant(bands * rows))
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in slices(offsets):
                n = j - i
                row, shingle = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                size = np.bincount(row, minlength=n)
                keys = band_keys(kept[0].signatures(row, shingle, n), bands, rows).astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(size)]).tolist()
                sha = [hashlib.sha256(shingle[a:b]).digest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                full = size > 0
                at = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                bits = parity(row, shingle, n)
                words_at = np.arange(n + 1, dtype=np.int32) * bits.shape[1]
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(size.astype(np.int64)), pa.array(sha, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[full].ravel())), pa.ListArray.from_arrays(pa.array(words_at), pa.array(bits.ravel()))], names=["row_no", "id", *ARROW_FEATURES.names])

    return texts.mapInArrow(made, T.StructType([*texts.schema.fields[:2], *FEATURES]))


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """(class, text) to (class, shingles): the sorted hashes of its set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                row, shingle = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                edge = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([shingle[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["class", "shingles"])

    return texts.mapInArrow(made, "class long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that hold on full sets. The set of an ``a`` with many partners goes out once a block of them."""
    few = pairs.count() <= FEW_PAIRS
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    if few:  # up to a checked number, pairs go to the sets, else both are dealt
        many, dealt = F.broadcast(many), F.broadcast(dealt)
    whole = many.join(sets, many.a == sets["class"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("of_a"))
    dealt = dealt.join(sets, dealt.b == sets["class"]).select("a", "b", "part", F.col("shingles").alias("of_b"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                hold.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hold, pa.bool_()))

    return dealt.join(whole, ["a", "part"]).select("a", "b", "of_a", "of_b").mapInArrow(compared, "a long, b long")


def frequent_keys(members: DataFrame, key: str, total: int, counted: list[Column]) -> DataFrame:
    """(key, size and more) of the keys that more than a 10,000th of the ``total`` members have.

    Such a key's first bits are at least as frequent; counts of these are few enough to be summed up in each
    task, and leave few members whose keys are counted."""
    limit = max(LEAST_FREQUENT, total // FREQUENT)
    first = F.shiftrightunsigned(key, 64 - FIRST_BITS)
    many = members.groupBy(first.alias("first_bits")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select("first_bits")
    return members.join(F.broadcast(many), first == F.col("first_bits"), "left_semi").groupBy(key).agg(*counted).where(F.col("size") > limit)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with n_shingles, component_id (the least id reachable), kept (id = component_id) and chosen (one row of each component).

    Columns of these names in ``docs`` are replaced.
    """
    docs = docs.drop("n_shingles", "component_id", "kept", "chosen")
    base, row, part = sliced(docs, text_col, "minhash-docs", common.SLICE_BYTES)
    spark = docs.sparkSession
    feat = materialise(features(base.select(F.col(row).alias("row_no"), F.col(id_col).alias("id"), F.col(text_col)), words, bands, rows), "minhash-features")
    full = feat.where("n_shingles > 0")
    classes = full.select("set_sha", "row_no", "n_shingles", "band_keys", "parity").groupBy("set_sha").agg(F.min(F.struct("row_no", "n_shingles", "band_keys", "parity")).alias("x")).select("set_sha", F.col("x.row_no").alias("class"), F.col("x.n_shingles").alias("n"), F.col("x.band_keys").alias("band_keys"), F.col("x.parity").alias("parity"))
    classes = materialise(classes, "minhash-classes")

    # keys that many classes have are counted with partial sums and go to all tasks; the others are dealt once, for the counts and the join alike
    members = classes.select(F.explode("band_keys").alias("key"), "class", "n")
    counted = [F.count("*").alias("size"), F.min(F.struct("class", "n")).alias("first")]
    frequent = F.broadcast(materialise(frequent_keys(members, "key", classes.count() * bands, counted), "minhash-frequent"))
    dealt = members.join(frequent, "key", "left_anti").repartition("key")
    shared = dealt.groupBy("key").agg(*counted).where("size > 1")
    buckets = materialise(dealt.join(shared, "key").unionByName(members.join(frequent, "key")), "minhash-buckets")

    def may_link(n: str, m: str) -> F.Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    first_pairs = materialise(buckets.where("class <> first.class").where(may_link("n", "first.n")).select(F.col("first.class").alias("a"), F.col("class").alias("b")).distinct(), "minhash-pairs")
    chosen_texts = materialise(buckets.select("class").distinct(), "minhash-wanted")
    # up to a checked number of ids they go to the texts, else both are dealt
    wanted = F.broadcast(chosen_texts) if chosen_texts.count() <= FEW_IDS else chosen_texts.hint("shuffle_hash")
    sets = base.select(F.col(row), F.col(text_col)).join(wanted, F.col(row) == F.col("class")).select("class", text_col)
    sets = materialise(full_sets(sets, words), "minhash-sets")
    links = materialise(verified(first_pairs, sets, percent), "minhash-links")
    found = components(links, "a", "b")

    # what the first comparisons leave open: buckets with classes of several components
    of = found.select(F.col("node").alias("class"), "component")
    named = buckets.select("key", "class", "n", "size").join(of, "class", "left").withColumn("component", F.coalesce("component", "class"))
    counts = named.groupBy("key", "component").agg(F.count("*").alias("own"))
    several = counts.groupBy("key").agg(F.count("*").alias("n"), F.max_by("component", F.struct("own", "component")).alias("major")).where("n > 1").select("key", "major")
    still = named.join(several, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    still = materialise(still.join(classes.select("class", "parity"), "class"), "minhash-open")
    # of two components in a bucket one isn't its largest: its classes meet all others, a block at a time
    left = still.where("component <> major").select("key", F.col("class").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), F.col("parity").alias("px"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = still.select("key", "block", F.col("class").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), F.col("parity").alias("py"))
    # 100 * |x and y| >= percent * |x or y| leaves so many members that only one of them has
    apart = reduce(add, (F.bit_count(F.get("px", i).bitwiseXOR(F.get("py", i))) for i in range(PARITY_BITS // 64)))
    near = apart * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
    more = left.join(right, ["key", "block"]).where("cx <> cy").where(may_link("nx", "ny") & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = materialise(more.join(first_pairs, ["a", "b"], "left_anti"), "minhash-more")
    late = verified(more, sets, percent)
    late = late.join(of.withColumnsRenamed({"class": "a", "component": "ca"}), "a", "left").join(of.withColumnsRenamed({"class": "b", "component": "cb"}), "b", "left")
    late = materialise(late.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "minhash-late")
    linked = components(late, "a", "b")
    joined = linked.select(F.col("node").alias("component"), F.col("component").alias("merged"))
    named = classes.select("set_sha", "class").join(of, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = named.join(joined, "component", "left").select("set_sha", F.coalesce("merged", "component").alias("component"))

    # a component's id is the least of its documents': of each set's rows, then of each component's sets
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_no"))
    own = feat.where("n_shingles > 0").groupBy("set_sha").agg(least.alias("x"), F.count("*").alias("rows"))
    own = materialise(named.join(own, "set_sha"), "minhash-sets-of")
    of_component = own.groupBy("component").agg(F.min("x").alias("least"), F.count("*").alias("n_sets"))
    total, n_classes = own.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    of_set = materialise(looked_up(own.select("component", "set_sha", "rows"), "component", of_component, "n_sets", n_classes).select("set_sha", "rows", "least"), "minhash-labels")
    labelled = looked_up(feat.where("n_shingles > 0").select("row_no", "set_sha"), "set_sha", of_set, "rows", total)
    labelled = labelled.select(F.col("row_no").alias(row), F.col("least.id").alias("component_id"), (F.col("row_no") == F.col("least.row_no")).alias("chosen"))
    discard(classes, buckets, first_pairs, chosen_texts, sets, links, found, still, more, late, linked, own)
    out = base.join(feat.select(F.col("row_no").alias(row), "n_shingles"), row).join(labelled, row, "left")
    label = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col))
    out = out.withColumn("component_id", label).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    return out.withColumn("chosen", F.coalesce("chosen", F.lit(True))).drop(row, part)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(text_frame(spark, sf_dir, "doc_id", "text"), words=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


#: The same result from all pairs that share one of the rarest shingles, without hashes of sets.
SQL = r"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS shingles FROM d),
sized AS (SELECT doc_id, len(shingles) AS n, shingles FROM s),
members AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM sized),
numbered AS (SELECT doc_id, n, dense_rank() OVER (ORDER BY shingle) AS shingle FROM members),
counted AS (SELECT *, count(*) OVER (PARTITION BY shingle) AS freq FROM numbered),
-- two sets at 0.8 share a shingle among the rarest n - ceil(0.8 n) + 1 of either
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq, shingle) AS place FROM counted),
rare AS (SELECT doc_id, n, shingle FROM placed WHERE place <= n - ((80 * n + 99) // 100) + 1),
candidates AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM rare a JOIN rare b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT c.a, c.b FROM candidates c JOIN numbered x ON x.doc_id = c.a JOIN numbered y ON y.doc_id = c.b AND y.shingle = x.shingle
  GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= 80 * (c.na + c.nb - count(*))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least_id USING (doc_id)"""
