"""Retrieval evaluated from documents alone: chunks, vectors of hashed terms, gold from anchors, search, metrics, worst cases."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions import scoring as S
from evalloom.operators import passages, retrieval
from evalloom.sources.scratch import written

DIMS = 128
#: Rows whose vectors a task makes at a time, and words whose entries it remembers.
SLICE, MOST_WORDS = 512, 1 << 19
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def with_term_vectors(rows: DataFrame, text: str, into: str = "embedding", dims: int = DIMS, least: int = 1) -> DataFrame:
    """``rows`` with a vector each: how often words (lower case, between white space) of at least so many characters fall on each entry.

    Null for texts without words. A text is counted where it is: nothing is dealt, and a word's entry is looked up once a task."""
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.ArrayType(T.DoubleType()))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry: dict[str, int] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                found, known = np.zeros((batch.num_rows, dims)), np.zeros(batch.num_rows, bool)
                for n, low in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    if words := [w for w in SPACE.split(low or "") if w and len(w) >= least]:
                        if len(entry) > MOST_WORDS:
                            entry.clear()
                        for w in words:
                            if w not in entry:
                                entry[w] = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:7], 16) % dims
                        found[n], known[n] = np.bincount([entry[w] for w in words], minlength=dims), True
                # a null in the starts would make the row before it longer
                starts = pa.array(np.append(0, np.cumsum(known) * dims), pa.int32())
                vectors = pa.ListArray.from_arrays(starts, pa.array(found[known].ravel()), mask=pa.array(~known))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=schema.names)

    return rows.withColumn("_low", F.lower(text)).mapInArrow(counted, schema)


def term_vectors(texts: DataFrame, id_col: str, text: str, into: str = "embedding", dims: int = DIMS, least: int = 1) -> DataFrame:
    """(id, vector) of texts, as ``with_term_vectors`` makes them; texts of one id are added up.

    Texts without words have no row."""
    each = with_term_vectors(texts.select(F.col(id_col), F.col(text)), text, into, dims, least).where(F.col(into).isNotNull())
    zeros = F.array_repeat(F.lit(0.0), dims)
    return each.groupBy(id_col).agg(F.aggregate(F.collect_list(into), zeros, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)).alias(into))


def chunk_points(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """(doc, point, text) of the sliding windows of documents (doc, text); a point's name is its document's and its number."""
    chunks = passages.fixed_chunks(docs, size, overlap, "doc")
    return chunks.select("doc", F.concat_ws(":", F.col("doc").cast("string"), F.col("index").cast("string")).alias("point"), F.lit("").alias("section"), "text")


class Entries(dict):
    """Entries of words, looked up once; forgotten when they are too many."""

    def __init__(self, dims: int) -> None:
        self.dims = dims

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        entry = self[word] = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:7], 16) % self.dims
        return entry


def window_counts(texts: list[str], lows: list[str], size: int, overlap: int, entry: Entries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of texts, numbers of windows, counts of words), at most ``TILE`` windows at a time, those without words left out; ``lows`` are the texts in lower case.

    Each word of the texts is looked up once; a window has the words that lie in it whole, and what it cuts off others at its ends."""
    joined, step = "\n".join(texts), size - overlap
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(np.diff((points == 32) | ((points >= 9) & (points <= 13)), prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    words = pc.ascii_split_whitespace(pa.array(["\n".join(lows)])).flatten()
    words = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
    different, word = words.dictionary.to_pylist(), words.indices.to_numpy()
    at = np.fromiter(map(entry.__getitem__, different), np.int64, len(different))[word]

    def cut(j: int, start: int, end: int) -> int:
        whole, low = joined[starts[j]:ends[j]], different[word[j]]
        # places stay unless a letter becomes two; a sigma's form depends on what follows
        same = len(low) == len(whole) and "\u03a3" not in whole
        return entry[low[start - starts[j]:end - starts[j]] if same else joined[start:end].lower()]

    length = np.array([len(t) for t in texts])
    base = np.cumsum(length + 1) - length - 1
    windows = np.where(length <= size, 1, -(-(length - size) // step) + 1)
    text = np.repeat(np.arange(len(texts)), windows)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    from_ = base[text] + nth * step
    to = np.minimum(from_ + size, (base + length)[text])
    for first in range(0, len(text), retrieval.TILE):
        a, b = (x[first:first + retrieval.TILE] for x in (from_, to))
        lo, hi = np.searchsorted(starts, a), np.searchsorted(ends, b, "right")
        n = np.maximum(hi - lo, 0)
        inside = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        cells = np.repeat(np.arange(len(a)), n) * entry.dims + at[inside]
        next_ = starts[np.minimum(hi, len(starts) - 1)]
        left = np.flatnonzero((lo > 0) & (ends[lo - 1] > a))
        right = np.flatnonzero((hi < len(starts)) & (a <= next_) & (next_ < b))
        more = [i * entry.dims + cut(lo[i] - 1, a[i], min(ends[lo[i] - 1], b[i])) for i in left]
        more += [i * entry.dims + cut(hi[i], next_[i], b[i]) for i in right]
        counts = np.bincount(np.append(cells, np.array(more, np.int64)), minlength=len(a) * entry.dims).reshape(len(a), -1)
        known = np.flatnonzero(counts.any(axis=1))
        yield text[first + known], nth[first + known], counts[known].astype(np.float64)


def window_tiles(docs: DataFrame, size: int = 500, overlap: int = 100, dims: int = DIMS) -> DataFrame:
    """``retrieval.tiles`` of the windows of documents (doc, text), named as by ``chunk_points``, with vectors as by ``with_term_vectors``.

    A task reads its documents and counts their words where they are; windows without words are left out."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, names, held = Entries(dims), [], []

        def tile() -> pa.RecordBatch:
            counts = np.concatenate(held)
            unit = counts / np.linalg.norm(counts, axis=1, keepdims=True)
            ids = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(names, pa.string()))
            return pa.RecordBatch.from_arrays([ids, pa.array([unit.tobytes()], pa.binary())], names=["ids", "vectors"])

        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                docs, texts, lows = (c.to_pylist() for c in whole.slice(i, SLICE).columns)
                for text, nth, counts in window_counts(texts, lows, size, overlap, entry):
                    names += [str(n) if docs[t] is None else f"{docs[t]}:{n}" for t, n in zip(text.tolist(), nth.tolist(), strict=True)]
                    held.append(counts)
                    if len(names) >= retrieval.TILE:
                        yield tile()
                        names, held = [], []
        if names:
            yield tile()

    kept = docs.where(F.length("text") > 0).select(F.col("doc").cast("string"), "text", F.lower("text").alias("_low"))
    return kept.mapInArrow(packed, T.StructType([T.StructField("ids", T.ArrayType(T.StringType())), T.StructField("vectors", T.BinaryType())]))


#: Questions that go to every task.
FEW = 1 << 14


def searched(docs: DataFrame, questions: DataFrame, k: int, size: int, overlap: int, dims: int = DIMS) -> DataFrame:
    """(qid, point, score, rank) of questions (point, embedding) over the windows of documents (doc, text); windows of up to ``FEW`` questions' search are dealt nowhere."""
    few = questions.limit(FEW + 1).count() <= FEW
    asked = retrieval.tiles((questions.coalesce(1) if few else questions).select("point", F.col("embedding").alias("v")), retrieval.BLOCK)
    return retrieval.nearest(window_tiles(docs, size, overlap, dims), asked, k, "point", few)


def evaluated(docs: DataFrame, cases: DataFrame, anchors: DataFrame, k: int = 5, size: int = 500, overlap: int = 100, dims: int = DIMS) -> tuple[DataFrame, DataFrame]:
    """(hits, metrics) of cases (qid, question) over documents (doc, text), with the chunks that hold a case's anchors (qid, doc, span) as gold.

    Cases without gold are not searched for, and have no metrics. Only documents with anchors are cut into texts, for gold; the search
    counts words where documents are, each once."""
    anchors = written(anchors.select("qid", "doc", "span"), "anchors")
    points = written(chunk_points(docs.join(anchors.select("doc").distinct(), "doc", "left_semi"), size, overlap), "chunks")
    gold = passages.anchored(anchors, points).select("qid", "point").distinct()
    gold = written(gold, "gold")
    asked = cases.join(gold.select("qid").distinct(), "qid", "left_semi")
    # queries and points have ids of one type; a question's can't be a point's, for these have a colon
    questions = term_vectors(asked, "qid", "question", dims=dims).select(F.col("qid").cast("string").alias("point"), "embedding")
    hits = searched(docs, written(questions, "questions"), k, size, overlap, dims).select("qid", "rank", "point", "score")
    hits = written(hits, "hits")
    named = asked.select(F.col("qid").cast("string").alias("qid"))
    return hits, retrieval.case_metrics(named, hits, gold.select(F.col("qid").cast("string").alias("qid"), "point"), k, "point")


def report(cases: DataFrame, metrics: DataFrame, k: int) -> DataFrame:
    """One row: the run's aggregate, with the cases that had no gold as skipped."""
    out = retrieval.run_aggregate(metrics, k)
    n = cases.agg(F.count("*").alias("n"))
    total = out.crossJoin(F.broadcast(n))
    return total.withColumn("cases_total", F.col("n")).withColumn("cases_skipped_no_gold", F.col("n") - F.col("cases_evaluated")).drop("n")


def worst(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The cases with the lowest recall, among equals those that were found last."""
    rank = F.coalesce("first_hit_rank", F.lit(0))
    return metrics.orderBy("recall", F.desc(rank), "qid").limit(n).select("qid", "recall", rank.alias("first_hit_rank"))


def flagged(metrics: DataFrame, k: int) -> DataFrame:
    """Metrics with the flags that retrieval alone can give."""
    nothing = F.lit(None).cast("struct<claims:bigint,unsupported:bigint,irrelevant:bigint,relevance:bigint,helpfulness:bigint>")
    return metrics.withColumn("flags", S.flags(F.struct("gold_count", "hits", "first_hit_rank"), nothing, k))
