"""Language ID by prediction by partial matching.

A language's model is a tree of byte contexts of order 0 to 3 with the counts of the bytes that followed.
The cost of a byte is its exact code length under escape method C: in the longest known context
``c / (n + t)`` for a byte seen there, else the escape ``t / (n + t)`` and the next shorter context;
below order 0 each byte costs 8 bits. Statistics are frozen: scoring never updates them.

Each text is preceded by ``ORDER`` line ends, so that its first bytes have contexts too; these are contexts like
others, with counts of their own.

Models are fitted on a bounded sample: at most ``rows_per_language`` different texts a language (the
smallest text hashes, each of at most ``sample_chars`` characters), so that a model is bounded whatever the
corpus; every whole text is scored.

Defined cases: a null text and a text without a letter get ``und`` and score 0; so does every text if
nothing was learned (an empty table, or no language that isn't null); null languages teach nothing, nor do null
and empty texts; equal code lengths go to the language first in order; repeated rows get equal results and are
learned from once; a text of any length is scored as a whole; other columns are kept, one named ``into`` is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.common import SLICE_BYTES, bounded_batches, discard, materialise, text_frame
from evalloom.llm.word_tokens import give_back

ORDER = 3
ROWS_PER_LANGUAGE = 300
SAMPLE_CHARS = 32768
PAD = b"\n" * ORDER

RESULT = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("bits_per_byte", T.DoubleType()),
    ]
)


class KeyIndex:
    """An open-addressing table from distinct unsigned keys to their rows, filled and probed by whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.rows = np.zeros(size, np.uint32), np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.rows[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot], self.rows[slot] = keys[left[put]], left[put]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        at = self._slot(keys)
        row = self.rows[at]
        wrong = np.flatnonzero((row >= 0) & (self.keys[at] != keys))
        for _ in range(self.probes):
            if not len(wrong):
                break
            next_at = (at[wrong] + 1) & (len(self.rows) - 1)
            at[wrong] = next_at
            row[wrong] = self.rows[next_at]
            wrong = wrong[(row[wrong] >= 0) & (self.keys[next_at] != keys[wrong])]
        row[wrong] = -1
        return row


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each position from n - 1 on, as one number."""
    out = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for k in range(n):
        out = (out << np.uint32(8)) | data[k : k + len(out)]
    return out


def count_contexts(texts: list[str]) -> pd.DataFrame:
    """The counts of the grams of 1 to ORDER + 1 bytes that end in a text; each text is preceded by padding."""
    frames = []
    parts = [PAD + t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    inside = np.ones(len(data), bool)
    start = np.cumsum([0, *map(len, parts)])[:-1]
    for k in range(ORDER):
        inside[start + k] = False
    for n in range(1, ORDER + 2):
        keys, count = np.unique(grams(data, n)[inside[n - 1 :]], return_counts=True)
        frames.append(pd.DataFrame({"n": n, "gram": keys.astype(np.int64), "count": count.astype(np.int64)}))
    return pd.concat(frames)


@dataclass
class Model:
    """Costs in bits of all known grams, a column a language; ``stats`` is what it was made of."""

    langs: list[str]
    keys: dict[int, np.ndarray]
    cost: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    escape: dict[int, np.ndarray]

    @classmethod
    def from_counts(cls, stats: dict[str, pd.DataFrame]) -> Model:
        langs = sorted(stats)
        width = len(langs)
        keys = {n: np.unique(np.concatenate([np.empty(0, np.int64), *(s.gram[s.n == n].to_numpy() for s in stats.values())])) for n in range(1, ORDER + 2)}
        base = np.full((256, width), 8.0)
        cost: dict[int, np.ndarray] = {}
        contexts: dict[int, np.ndarray] = {}
        escape: dict[int, np.ndarray] = {}
        for n in range(1, ORDER + 2):
            # what the n - 1 bytes before are; padding before a text makes contexts that end in no text
            contexts[n], ctx = np.unique(keys[n] >> 8, return_inverse=True)
            # the cost without the first of them: of the same byte after the next shorter context
            fallback = base[keys[1]] if n == 1 else cost[n - 1][np.searchsorted(keys[n - 1], keys[n] & ((1 << 8 * (n - 1)) - 1))]
            escape[n] = np.zeros((len(contexts[n]), width))
            out = np.zeros((len(keys[n]), width))
            for j, lang in enumerate(langs):
                s = stats[lang][stats[lang].n == n]
                count = np.zeros(len(keys[n]))
                count[np.searchsorted(keys[n], s.gram.to_numpy())] = s["count"].to_numpy()
                total = np.bincount(ctx, count, minlength=len(contexts[n]))
                kinds = np.bincount(ctx, count > 0, minlength=len(contexts[n]))
                seen = total > 0
                escape[n][seen, j] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                with np.errstate(divide="ignore"):
                    out[:, j] = np.where(count > 0, -np.log2(count / np.maximum(total + kinds, 1)[ctx]), escape[n][ctx, j] + fallback[:, j])
            cost[n] = out
        return cls(langs, keys, cost, contexts, escape)

    def tables(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model made ready for arrays: dense tables up to two bytes, probed tables beyond."""

    def __init__(self, model: Model) -> None:
        self.langs, width = model.langs, len(model.langs)
        one = np.full((256, width), 8.0) + (model.escape[1][0] if len(model.escape[1]) else 0.0)
        one[model.keys[1]] = model.cost[1]
        escape2 = np.zeros((256, width))
        escape2[model.contexts[2]] = model.escape[2]
        two = (escape2[:, None, :] + one[None, :, :]).reshape(65536, width)
        two[model.keys[2]] = model.cost[2]
        self.two = two.astype(np.float32)
        self.escape3 = np.zeros((65536, width), np.float32)
        self.escape3[model.contexts[3]] = model.escape[3]
        self.index3, self.cost3 = KeyIndex(model.keys[3].astype(np.uint32)), model.cost[3].astype(np.float32)
        self.contexts4, self.escape4 = KeyIndex(model.contexts[4].astype(np.uint32)), model.escape[4].astype(np.float32)
        self.index4, self.cost4 = KeyIndex(model.keys[4].astype(np.uint32)), model.cost[4].astype(np.float32)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text under each language."""
        data = np.frombuffer(PAD + PAD.join(texts) + PAD, np.uint8)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        four = grams(data, ORDER + 1)
        row = self.index4.find(four)
        cost = self.cost4[row] if len(self.cost4) else np.zeros((len(four), len(self.langs)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            key = four[miss]
            low = key & np.uint32(0xFFFFFF)
            at = self.index3.find(low)
            pair = low & np.uint32(0xFFFF)
            short = self.two[pair] + self.escape3[low >> np.uint32(8)]
            if len(self.cost3):
                short = np.where((at >= 0)[:, None], self.cost3[at], short)
            if len(self.escape4):
                context = self.contexts4.find(key >> np.uint32(8))
                short = short + np.where((context >= 0)[:, None], self.escape4[context], np.float32(0))
            cost[miss] = short
        begin = np.cumsum([0, *(length + ORDER)])[:-1]
        stop = begin + length
        both = np.ravel(np.column_stack([begin, stop]))
        sums = np.add.reduceat(np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)]), both, axis=0, dtype=np.float64)[::2]
        sums[length == 0] = 0
        return sums


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fits a model a language on at most ``rows_per_language`` texts of each, ``sample_chars`` characters of a longer one. The counts, bounded by the sample, come to the driver."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # the smallest hashes of each language: tasks keep so many each before any are dealt, and a row a language comes of them
    order = Window.partitionBy("lang").orderBy("h")
    least = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_language)
    cut = materialise(least.groupBy("lang").agg(F.max("h").alias("cut")), "langid-sample")
    stats: dict[str, pd.DataFrame] = {}
    if not cut.isEmpty():
        sample = rows.join(cut, "lang").where("h <= cut").withColumn("text", F.substring("text", 1, sample_chars)).dropDuplicates(["lang", "h"]).select("lang", "text")

        def counted(key: tuple[str], frame: pd.DataFrame) -> pd.DataFrame:
            return count_contexts(frame.text.tolist()).assign(lang=key[0])[["lang", "n", "gram", "count"]]

        found = sample.groupBy("lang").applyInPandas(counted, "lang string, n long, gram long, count long").toPandas()
        stats = {k: v for k, v in found.groupby("lang")}
    discard(cut)
    return Model.from_counts(stats)


def identifier(model: Model) -> object:
    """A column function that scores texts under ``model``: language, score and bits a byte."""
    scorer: list[Scorer] = []

    @F.arrow_udf(RESULT)
    def identify_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        if not scorer:
            scorer.append(model.tables())
        for column in batches:
            texts = column.to_pylist()
            langs: list[str] = []
            scores: list[float] = []
            costs: list[float | None] = []
            i = 0
            while i < len(texts):
                size, j, part = 0, i, []
                while j < len(texts) and (j == i or size < SLICE_BYTES // 2):
                    part.append((texts[j] or "").encode("utf-8", "replace"))
                    size += len(part[-1])
                    j += 1
                bits = scorer[0].bits(part) if model.langs else np.zeros((len(part), 0))
                for raw, text, b in zip(part, texts[i:j], bits, strict=True):
                    if not len(b) or text is None or not has_letter(text):
                        langs.append("und")
                        scores.append(0.0)
                        costs.append(None)
                        continue
                    best = int(np.argmin(b))
                    langs.append(model.langs[best])
                    scores.append(float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum()))
                    costs.append(float(b[best] / len(raw)))
                i = j
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(costs, pa.float64())], names=["lang", "score", "bits_per_byte"])

    return identify_texts


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: str = "langid") -> DataFrame:
    """``docs`` with a struct ``into`` (lang, score, bits_per_byte); a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, identifier(model)(F.col(text_col)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document stays out of fitting: crc32 of its id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_frame(spark, sf_dir, "doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("langid.lang").alias("lang_pred"), F.col("langid.score").alias("score"), F.col("langid.bits_per_byte").alias("bits_per_byte"))
