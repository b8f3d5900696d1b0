"""Best-fit packing with certified bin counts.

A document's ids, by a public tokeniser, and an end id are cut into pieces only if longer than a sequence.
Pieces are dealt to groups of about ``GROUP_SEQUENCES`` sequences by a hash of their number; best-fit
decreasing packs each group. Dual-feasible functions (rounding by k and thresholds) give each group a lower
bound on its sequences. A group that meets its bound is certified. Groups with a gap release the pieces of
their sequences that aren't full; these are dealt anew and packed again, which is kept if it saves sequences,
for at most ``ROUNDS`` rounds.

The tokeniser sees words cut at ASCII white space, which its own rules never join across, so that each
different word is encoded once a worker.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; ties in length go by
the pieces' numbers; an empty table gives an empty result; a text of any length is encoded whole and cut into
pieces; of other columns only the id is kept.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.common import HASH, bounded_batches, materialise, slices, text_frame, trim, utf8, vocabulary_path
from evalloom.llm.word_tokens import WordTokens, json_tokenizer, kept_in_worker, text_ids

VOCABULARY = "word_bpe_49k.json"
SEQUENCE = 2048
END_ID = 0
GROUP_SEQUENCES = 20_000
ROUNDS = 3
#: Text that is encoded at once.
TEXT_BYTES = 6 << 20


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """A row for each piece: the id, piece, start, length, ids_crc32 and, if asked for, its ids."""
    bounded_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path(VOCABULARY)
    id_field = docs.schema[id_col]
    fields = [T.StructField(id_col, id_field.dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        HASH.release()
        trim()
        gc.disable()  # words and ids make no cycles, and there are millions
        tokens = kept_in_worker("packing", path, lambda p: WordTokens(json_tokenizer(p)))
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, TEXT_BYTES):
                ids, at = text_ids(batch.column(1)[i:j], tokens)
                row, piece, start, length, crc, lists = [], [], [], [], [], []
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    whole = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    for p, s in enumerate(range(0, len(whole), size)):
                        own = whole[s : s + size]
                        row.append(k)
                        piece.append(p)
                        start.append(s)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            lists.append(own.astype(np.int32))
                columns = [batch.column(0)[i:j].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    return docs.select(id_col, text_col).mapInArrow(cut, T.StructType(fields))


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences that no packing can go below: the best of the dual-feasible functions tried."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // size)
    # rounding: x stays if (k + 1) x is a multiple of the size, else goes down to a k-th part of it
    for k in range(1, 24):
        part = (k + 1) * x
        rounded = np.where(part % size == 0, x * k, part // size * size)
        best = max(best, -(-int((count * rounded).sum()) // (size * k)))
    # thresholds: those above size - t count whole, those below t nothing
    below = np.cumsum(count)
    weight = np.cumsum(count * x)
    t = np.arange(1, size // 2 + 1)
    large = (below[-1] - below[size - t]) * size
    middle = weight[size - t] - weight[t - 1]
    return max(best, int((-(-(large + middle) // size)).max(initial=0)))


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. Longest first; each goes where least room is left."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = size, n, n + 1
        bins[i], offsets[i] = b, size - room
        left = room - need
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, n


PACKED = "piece_no long, length long, round_no int, group_no int, bin long, offset long, room long, bins long, bound long"
ARROW_PACKED = pa.schema([("piece_no", pa.int64()), ("length", pa.int64()), ("round_no", pa.int32()), ("group_no", pa.int32()), ("bin", pa.int64()), ("offset", pa.int64()), ("room", pa.int64()), ("bins", pa.int64()), ("bound", pa.int64())])


def packed_groups(items: DataFrame, groups: int, round_no: int, size: int) -> DataFrame:
    """(piece_no, length) with each one's place, the room left in its bin, and its group's bins and bound."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("piece_no", "ascending")])
        number, length = group.column("piece_no").to_numpy(), group.column("length").to_numpy()
        bins, offsets, n = best_fit_decreasing(length, size)
        room = size - np.bincount(bins, length, minlength=n).astype(np.int64)
        same = np.ones(len(length), np.int64)
        columns = [number, length, same * round_no, same * group.column("group_no")[0].as_py(), bins, offsets, room[bins], same * n, same * lower_bound(length, size)]
        return pa.table([pa.array(c).cast(f.type) for c, f in zip(columns, ARROW_PACKED, strict=True)], schema=ARROW_PACKED)

    dealt = items.select("piece_no", "length", F.pmod(F.xxhash64("piece_no", F.lit(round_no)), F.lit(groups)).cast("int").alias("group_no"))
    return dealt.groupBy("group_no").applyInArrow(pack, PACKED)


def pack(parts: DataFrame, size: int = SEQUENCE, group_sequences: int = GROUP_SEQUENCES, rounds: int = ROUNDS) -> DataFrame:
    """``parts`` (with a column length, at most ``size``) with sequence_id and offset, and the certificate of the last dealing.

    ``certified`` says whether the piece's group met its lower bound.
    """
    parts = materialise(parts.withColumn("piece_no", F.monotonically_increasing_id()), "packing-pieces")
    done: list[DataFrame] = []
    items, tokens = parts.select("piece_no", "length"), parts.agg(F.sum("length")).first()[0] or 0
    now = materialise(packed_groups(items, max(1, -(-tokens // (size * group_sequences))), 0, size), "packing-0")
    for round_no in range(1, rounds + 1):
        open_bins = now.where("bins > bound and room > 0")
        found = open_bins.agg(F.sum("length"), F.countDistinct("group_no"), F.countDistinct("group_no", "bin")).first()
        if not found[0] or found[1] < 2:
            break
        again = materialise(packed_groups(open_bins, max(1, -(-found[0] // (size * group_sequences))), round_no, size), f"packing-{round_no}")
        bins = again.select("group_no", "bins").distinct().agg(F.sum("bins")).first()[0]
        if bins >= found[2]:
            break
        done.append(now.where("not (bins > bound and room > 0)"))
        now = again
    for part in done:
        now = now.unionByName(part)
    sequence = F.shiftleft(F.col("round_no").cast("long"), 58) + F.shiftleft(F.col("group_no").cast("long"), 32) + F.col("bin")
    placed = now.select("piece_no", sequence.alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified"))
    return parts.join(placed, "piece_no").drop("piece_no")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(text_frame(spark, sf_dir, "doc_id", "text")))
