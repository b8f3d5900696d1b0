"""Removal of repeated passages by a distributed difference-cover suffix sort of bounded depth.

Only suffixes' first ``length`` bytes matter here, so the sort stops at that depth and its order is that of
fingerprints (equal prefixes are adjacent in it, as in a suffix array). Sampled suffixes are those whose place
in their document, modulo the cover's period v, lies in a difference cover: any two suffixes reach a common
sampled place within v - 1 steps.

1. Tuples: the prefixes of ``length - v + 1`` bytes of sampled suffixes are sorted over the cluster; names
   that occur once drop out, with every suffix that reaches only such names.
2. Recursion on names: sampled suffixes left are named again at depth ``length + v``. Equal names there
   settle v + 1 suffixes at once, up to the next sampled place that the two copies share. One slice leads
   for each such name.
3. Merge: suffixes that are neither dropped nor settled are sorted by their first ``length`` bytes, together
   with those settled ones that their slice leads: one copy stands for all in the comparison.
4. Adjacent equal prefixes mark repeated strings; the bytes that they cover are removed.

Every sort moves one sorted block of 64-bit fingerprints for each slice of text and range of fingerprints. A
fingerprint that a slice holds often is sent twice at most, so that a passage which a third of all documents
share puts two numbers for each slice into its range. A bit for each fingerprint comes back. Ranges are as many as the corpus needs to keep each
within ``RANGE_BYTES``. Names that decide are a fingerprint modulo 2^61 - 1 and 24 bits of a second one modulo 2^64
with another base; among n suffixes that get to one sort a false match comes with probability n^2 / 2^86. The
tuples of step 1 only decide what is looked at again, and go without the second.

Defined cases: null texts are empty; documents shorter than ``length`` and empty ones lose nothing; repeated
rows are different documents, so that both lose all they have if long enough; matches may overlap and may lie
in one document; an empty table gives an empty result; texts of any length are taken whole; other columns are
kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.common import HASH, bounded_batches, materialise, mix, powers, slices, text_frame, utf8
from evalloom.llm.word_tokens import give_back, ragged

LENGTH = 200
SLICE_BYTES = 2 << 20
RANGE_BYTES = 12 << 20
# Perfect difference sets by period; each residue is a difference of two members.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121),
}
#: Levels of names: of tuples, at the larger depth, at the asked depth, and those at the larger depth that a slice leads.
TUPLES, LONG, WHOLE, LED = range(4)
#: The base of the second fingerprint. Two texts under 1,024 bytes can't have one by the structure of powers of two alone.
BASE = 0x9E3779B97F4A7C15
#: Fingerprints and, beside each, 24 bits of its second one.
Names = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Depths:
    """The period and the three depths at which suffixes are compared."""

    length: int

    @property
    def period(self) -> int:
        return max(v for v in COVERS if v == 3 or 3 * v <= self.length)

    @property
    def tuple(self) -> int:
        return self.length - self.period + 1

    @property
    def long(self) -> int:
        return self.length + self.period


class Slice:
    """The documents of one slice as bytes, and the suffixes that each step asks for."""

    def __init__(self, texts: pa.Array, depths: Depths) -> None:
        self.depths = depths
        self.data, self.offsets = utf8(texts)
        self.size = np.diff(self.offsets)
        self.prefix = HASH.prefix(self.data)
        v = depths.period
        # the cover's places up to the longest document; each document has those with a whole tuple
        longest = int(self.size.max(initial=0))
        pattern = (np.arange(0, longest + v, v)[:, None] + np.array(COVERS[v])).ravel()
        count = np.searchsorted(pattern, self.size - depths.tuple, side="right") * (self.size >= depths.length)
        self.place = pattern[ragged(np.zeros(len(count), np.int64), count)]
        self.sampled = self.place + np.repeat(self.offsets[:-1], count)
        self.end = np.repeat(self.offsets[1:], count)

    @cached_property
    def second(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums up to each byte of its code times its power, and what takes the power out again."""
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(self.data)), dtype=np.uint64, out=sums[1:])
        return sums, powers(pow(BASE, -1, 1 << 64), len(self.data))

    def names(self, at: np.ndarray, depth: int) -> Names:
        values = HASH.ranges(self.prefix, at, at + depth)
        if depth < self.depths.length or not len(at):
            return values, np.zeros(len(at), np.uint32)
        sums, down = self.second
        return values, (mix((sums[at + depth] - sums[at]) * down[at]) >> np.uint64(40)).astype(np.uint32)

    def repeated_samples(self, names: Names) -> np.ndarray:
        """Which samples' tuples have one of the names."""
        return np.flatnonzero(among(self.names(self.sampled, self.depths.tuple), names))

    def long_samples(self, names: Names) -> np.ndarray:
        which = self.repeated_samples(names)
        at = self.sampled[which]
        return at[self.end[which] - at >= self.depths.long]

    def settled(self, long_samples: np.ndarray, long_names: Names) -> np.ndarray:
        """Which suffixes step 2 shows to be repeated (given the names that the slice leads: which it stands for)."""
        at = long_samples[among(self.names(long_samples, self.depths.long), long_names)]
        return marked(at, at + self.depths.period + 1, len(self.data))

    def open(self, names: Names, settled: np.ndarray) -> np.ndarray:
        """The suffixes that step 1 leaves and step 2 doesn't settle."""
        which = self.repeated_samples(names)
        at = self.sampled[which]
        first = np.maximum(at - (self.depths.period - 1), at - self.place[which])
        last = np.minimum(at, self.end[which] - self.depths.length)
        some = first <= last
        return np.flatnonzero(marked(first[some], last[some] + 1, len(self.data)) & ~settled)


def places(values: Names, names: Names) -> np.ndarray:
    """Where each value is in the ordered ``names``; -1 where it isn't."""
    if not len(names[0]):
        return np.full(len(values[0]), -1)
    at = np.searchsorted(names[0], values[0])
    at[at == len(names[0])] = 0
    like = names[0][at] == values[0]
    out = np.where(like & (names[1][at] == values[1]), at, -1)
    left = np.flatnonzero(like & (out < 0))
    while len(left):  # names may share a fingerprint and differ in the second
        at[left] += 1
        left = left[at[left] < len(names[0])]
        left = left[names[0][at[left]] == values[0][left]]
        hit = names[1][at[left]] == values[1][left]
        out[left[hit]] = at[left[hit]]
        left = left[~hit]
    return out


def among(values: Names, names: Names) -> np.ndarray:
    """Which values are in the ordered ``names``."""
    return places(values, names) >= 0


def taken(names: Names, which: np.ndarray | slice) -> Names:
    return names[0][which], names[1][which]


def joined(parts: list[Names]) -> Names:
    return np.concatenate([np.empty(0, np.uint64), *(p[0] for p in parts)]), np.concatenate([np.empty(0, np.uint32), *(p[1] for p in parts)])


def ordered(names: Names) -> Names:
    out = taken(names, np.argsort(names[0]))
    if ((out[0][1:] == out[0][:-1]) & (out[1][1:] < out[1][:-1])).any():
        out = taken(names, np.lexsort(names[::-1]))
    return out


def equal(names: Names, apart: int) -> np.ndarray:
    """Of ordered names from the one numbered ``apart`` on, which are equal to the one so far before."""
    return (names[0][apart:] == names[0][:-apart]) & (names[1][apart:] == names[1][:-apart])


def distinct(names: Names) -> Names:
    """Ordered names, each once."""
    return taken(names, np.append(np.ones(min(1, len(names[0])), bool), ~equal(names, 1)))


def marked(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    out = np.zeros(n, bool)
    if len(start):
        order = np.argsort(start, kind="stable")
        start, reach = start[order], np.maximum.accumulate(np.minimum(end, n)[order])
        # ranges that overlap or touch are one
        new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
        first, last = start[new], reach[np.append(new[1:], len(start)) - 1]
        out[ragged(first, last - first)] = True
    return out


def at_most_twice(names: Names) -> Names:
    """Ordered, each name twice at most."""
    names = ordered(names)
    keep = np.ones(len(names[0]), bool)
    keep[2:] = ~equal(names, 2)
    return taken(names, keep)


def cuts(values: np.ndarray, ranges: int) -> list[int]:
    """Where sorted fingerprints go from one range to the next."""
    edges = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
    return [0, *np.searchsorted(values, edges).tolist(), len(values)]


def blocks(slice_no: int, names: Names, ranges: int) -> Iterator[tuple[int, int, bytes]]:
    """A sorted block of fingerprints for each range of them."""
    names = at_most_twice(names)
    at = cuts(names[0], ranges)
    for r in range(ranges):
        if at[r] < at[r + 1]:
            yield r, slice_no, wire(taken(names, slice(at[r], at[r + 1])))


def named_of(sent: Names, found: pa.Table, level: int, ranges: int) -> Names:
    """Of the names that a slice sent, those whose bits came back; ordered, each once."""
    names = at_most_twice(sent)
    at = cuts(names[0], ranges)
    out = []
    for own, r, bits in zip(found.column("level").to_pylist(), found.column("range_no").to_pylist(), found.column("bits"), strict=True):
        if own == level:
            part = taken(names, slice(at[r], at[r + 1]))
            out.append(taken(part, np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(part[0])).astype(bool)))
    return distinct(ordered(joined(out)))


BLOCKS = T.StructType([T.StructField("range_no", T.IntegerType()), T.StructField("slice_no", T.LongType()), T.StructField("names", T.BinaryType())])
BITS = T.StructType([T.StructField("slice_no", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("range_no", T.IntegerType()), T.StructField("bits", T.BinaryType())])
ARROW_BLOCKS = pa.schema([("range_no", pa.int32()), ("slice_no", pa.int64()), ("names", pa.binary())])
ARROW_BITS = pa.schema([("slice_no", pa.int64()), ("level", pa.int32()), ("range_no", pa.int32()), ("bits", pa.binary())])


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def named(sent: DataFrame, level: int, name: str) -> DataFrame:
    """For each slice's block, a bit for each name: whether it occurs twice or more anywhere."""

    def compare(group: pa.Table) -> pa.Table:
        parts = [unwire(x.as_py()) for x in group.column("names")]
        both = ordered(joined(parts))
        names = distinct(taken(taken(both, slice(1, None)), equal(both, 1)))
        rows, led = [], np.zeros(len(names[0]), bool)
        range_no = group.column("range_no")[0].as_py()
        for slice_no, part in zip(group.column("slice_no").to_pylist(), parts, strict=True):
            at = places(part, names)
            if (hit := at >= 0).any():
                rows.append((slice_no, level, range_no, np.packbits(hit).tobytes()))
                at = at[hit]
                if level == LONG and not led[at].all():
                    first = hit.copy()
                    first[hit] = ~led[at]
                    rows.append((slice_no, LED, range_no, np.packbits(first).tobytes()))
                    led[at] = True
        return table(rows, ARROW_BITS)

    return materialise(sent.groupBy("range_no").applyInArrow(compare, BITS), name)


def wire(names: Names) -> bytes:
    """Ordered fingerprints as the bytes of their differences, the first byte of each first: high ones are zeros that compress. The second ones follow."""
    return np.diff(names[0], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + names[1].view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unwire(raw: bytes) -> Names:
    n = len(raw) // 11
    steps, second = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, -1), np.zeros((n, 4), np.uint8)
    second[:, :3] = np.frombuffer(raw, np.uint8, 3 * n, 8 * n).reshape(-1, 3)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64), second.view(np.uint32).ravel()


def row_blocks(docs: DataFrame, text_col: str, slice_bytes: int) -> DataFrame:
    """``docs`` as (slice_no, n_bytes, rows): runs of rows of one task with about ``slice_bytes`` of text, each a compressed Arrow stream."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def packed(slice_no: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(batches).combine_chunks())
        size = sum(pc.sum(pc.binary_length(b.column(at))).as_py() or 0 for b in batches)
        return pa.RecordBatch.from_arrays([pa.array([slice_no]), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice_no", "n_bytes", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, filled = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            _, offsets = utf8(batch.column(at))
            for i, j in slices(offsets, slice_bytes):
                held.append(batch.slice(i, j - i))
                filled += int(offsets[j] - offsets[i])
                if filled >= slice_bytes // 2:
                    yield packed(number, held)
                    number, held, filled = number + 1, [], 0
        if held:
            yield packed(number, held)

    return materialise(docs.mapInArrow(pack, "slice_no long, n_bytes long, rows binary"), "suffix-slices")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, slice_bytes: int = SLICE_BYTES, in_place: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, removed (spans of bytes) and kept (the other bytes, concatenated).

    Columns of these names in ``docs`` are replaced. ``in_place``: ``docs`` with the texts that are left, and no more
    columns; characters cut apart at a span's edge are left out.
    """
    depths = Depths(length)
    docs = docs if in_place else docs.drop("n_bytes", "n_removed", "removed", "kept")
    base = row_blocks(docs, text_col, slice_bytes)
    text_at = docs.columns.index(text_col)
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    sampled_bytes = 8 * total * len(COVERS[depths.period]) // depths.period
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sampled_bytes // RANGE_BYTES))

    def rows_of(block: pa.Scalar) -> pa.Table:
        return pa.ipc.open_stream(block.as_buffer()).read_all().combine_chunks()

    def slice_of(rows: pa.Table) -> Slice:
        give_back()
        column = rows.column(text_at)
        return Slice(column.chunk(0) if column.num_chunks else pa.array([], pa.string()), depths)

    def first_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = slice_of(rows_of(block))
                yield from table(list(blocks(number, s.names(s.sampled, depths.tuple), ranges)), ARROW_BLOCKS).to_batches()

    def known(s: Slice, found: pa.Table) -> tuple[Names, np.ndarray]:
        """The tuples that occur again, and the samples that are compared at the larger depth."""
        tuples = named_of(s.names(s.sampled, depths.tuple), found, TUPLES, ranges)
        return tuples, s.long_samples(tuples)

    def long_names(group: pa.Table, found: pa.Table) -> pa.Table:
        if not group.num_rows or not found.num_rows:
            return table([], ARROW_BLOCKS)
        s = slice_of(rows_of(group.column(1)[0]))
        _, long_samples = known(s, found)
        return table(list(blocks(group.column(0)[0].as_py(), s.names(long_samples, depths.long), ranges)), ARROW_BLOCKS)

    def merged(s: Slice, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What step 2 settles, the suffixes it leaves open, and the settled ones that the slice leads."""
        tuples, long_samples = known(s, found)
        sent = s.names(long_samples, depths.long)
        settled = s.settled(long_samples, named_of(sent, found, LONG, ranges))
        led = s.settled(long_samples, named_of(sent, found, LED, ranges))
        return settled, s.open(tuples, settled), np.flatnonzero(led)

    def open_names(group: pa.Table, found: pa.Table) -> pa.Table:
        if not group.num_rows or not found.num_rows:
            return table([], ARROW_BLOCKS)
        s = slice_of(rows_of(group.column(1)[0]))
        at = np.concatenate(merged(s, found)[1:])
        return table(list(blocks(group.column(0)[0].as_py(), s.names(at, length), ranges)), ARROW_BLOCKS)

    keyed = base.select("slice_no", "rows")

    def with_names(step: object, schema: T.StructType, *known: DataFrame) -> DataFrame:
        found = known[0]
        for more in known[1:]:
            found = found.union(more)
        return keyed.groupBy("slice_no").cogroup(found.groupBy("slice_no")).applyInArrow(step, schema)

    one = named(keyed.mapInArrow(first_names, BLOCKS), TUPLES, "suffix-tuples")
    two = named(with_names(long_names, BLOCKS, one), LONG, "suffix-names")
    three = named(with_names(open_names, BLOCKS, one, two), WHOLE, "suffix-merge")

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    more = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span), T.StructField("kept", T.BinaryType())])
    schema = docs.schema if in_place else T.StructType([*docs.schema.fields, *more.fields])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(group: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows_of(group.column(1)[0])
        s = slice_of(rows)
        n = len(s.data)
        removed = np.zeros(n, bool)
        if found.num_rows:
            settled, at, led = merged(s, found)
            again = named_of(s.names(np.concatenate([at, led]), length), found, WHOLE, ranges)
            start = np.concatenate([np.flatnonzero(settled), at[among(s.names(at, length), again)]])
            removed = marked(start, start + length, n)
        spans, kept, gone = [], [], []
        for i, j in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True):
            own = removed[i:j]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            kept.append(s.data[i:j][~own].tobytes() if len(edges) else s.data[i:j].tobytes())
            gone.append(int(own.sum()))
        if in_place:
            texts = rows.column(text_at).to_pylist()
            texts = [t if t is None or not n else k.decode("utf-8", "ignore") for t, k, n in zip(texts, kept, gone, strict=True)]
            return rows.set_column(text_at, rows.schema.field(text_at), pa.array(texts, rows.schema.field(text_at).type))
        columns = [*rows.columns, pa.array(s.size.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(spans, arrow_span), pa.array(kept, pa.binary())]
        return pa.table(columns, names=[*rows.column_names, "n_bytes", "n_removed", "removed", "kept"])

    return with_names(cut, schema, one, two, three)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(text_frame(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same result from all strings of 200 bytes, by hexadecimal digits.
SQL = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
sized AS (SELECT doc_id, x, len(x) // 2 AS n FROM h),
starts AS (SELECT doc_id, x, unnest(range(0, n - 199)) AS p FROM sized WHERE n >= 200),
windows AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 400)) AS name FROM starts),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY name) AS c FROM windows) WHERE c > 1),
marked AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 1 ELSE 0 END AS opens FROM repeated),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
runs AS (SELECT doc_id, run, min(p) AS b, max(p) + 200 AS e FROM numbered GROUP BY doc_id, run),
ordered AS (SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM runs),
removed AS (SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last_end, array_agg(before ORDER BY b) AS f, array_agg(b ORDER BY b) AS t FROM ordered GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE list_aggregate(list_transform(range(1, len(f) + 1), lambda i: substr(x, 2 * f[i] + 1, 2 * (t[i] - f[i]))), 'string_agg', '') || substr(x, 2 * last_end + 1) END)) AS kept_sha256
FROM sized LEFT JOIN removed USING (doc_id)"""
