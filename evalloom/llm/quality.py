"""Quality rules: base counts and tokeniser fertility.

A public vocabulary's pieces measure a text: characters per token, the share of tokens that are byte
fallbacks, and the entropy of its tokens as a share of what that many tokens could have. Each word is encoded
by itself. Bands of the three reject texts on which a tokeniser breaks down (too few characters a token, many
bytes, tokens as even as noise) or has too little to do (one token again and again). They are learned from the
whole corpus: median and quartiles of the texts that pass the base rules, by language and length in tokens,
and fences ``FENCE`` standard deviations (as the quartiles give them) around the median, so that junk has to be
a quarter of a language's texts before it moves them. The script is that of most letters.

Defined cases: a null or empty text has no words, counts of 0, null measures, and fails the base rules; an empty
table gives an empty result; texts of any length are measured whole; repeated rows give equal results; a column
named ``quality`` is replaced, others are kept; ties between scripts go to the first in ``SCRIPTS``; a text without letters
has script ``none`` and that band. A language and length with fewer than ``LEAST_TEXTS`` texts takes the band of
its language, then of its script; the fixed limits in ``BANDS`` hold besides, and alone where no band is learned.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import HASH, fresh, looked_up, materialise, mix, slices, text_frame, utf8, vocabulary_path, words
from evalloom.llm.word_tokens import WordTokens, flattened, kept_in_worker, text_ids

VOCABULARY = "piece_bpe_32k.model"
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
# The blocks of Unicode that hold a script's letters.
BLOCKS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB64), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "indic": ((0x900, 0xDFF),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
    "armenian": ((0x530, 0x58F), (0xFB13, 0xFB17)),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "burmese": ((0x1000, 0x109F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)),
    "khmer": ((0x1780, 0x17FF),),
}
#: Scripts in order; letters outside all blocks are of another one.
SCRIPTS = (*BLOCKS, "other")
# Bands: least characters a token, largest share of byte tokens, least share of the possible entropy.
BANDS = {"latin": (1.10, 0.30, 0.20), "greek": (0.70, 0.50, 0.20), "cyrillic": (1.00, 0.40, 0.20), "arabic": (0.60, 0.60, 0.20), "indic": (0.35, 0.90, 0.15), "kana": (0.50, 0.60, 0.20), "han": (0.40, 0.80, 0.20), "hangul": (0.40, 0.80, 0.20), "none": (1.00, 0.30, 0.20)}
BANDS |= {"armenian": (0.50, 0.80, 0.20), "hebrew": (0.60, 0.60, 0.20), "thai": (0.35, 0.90, 0.15)} | dict.fromkeys(("lao", "tibetan", "burmese", "georgian", "ethiopic", "khmer", "other"), (0.30, 1.00, 0.15))
#: Half the width of a learned band in standard deviations; the least one of each measure; the least texts of a band.
FENCE = 6.0
LEAST_SPREAD = {"chars_per_token": 0.02, "byte_share": 0.02, "entropy_share": 0.005}
LEAST_TEXTS = 100


@cache
def script_codes() -> np.ndarray:
    """For each code point the number of its script from 1; 0 for what isn't a letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    out[letters] = len(SCRIPTS)
    for i, blocks in enumerate(BLOCKS.values(), 1):
        for first, last in blocks:
            out[first : last + 1] = np.where(letters[first : last + 1], i, 0)
    return out


MEASURES = pa.schema(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")]
    + [("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("entropy_share", pa.float64()), ("script", pa.string())]
)
SPARK_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy_share double, script string"


def repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries' (group, value) occurs twice or more, and which of those came earlier as well; entries are in order."""
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    g, v = group[order], value[order]
    same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    twice, again = np.zeros(len(group), bool), np.zeros(len(group), bool)
    twice[order[1:][same]] = True
    again[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, again


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n = len(offsets) - 1
    start, end, row = words(data, offsets)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    n_words = np.bincount(row, minlength=n)
    word_chars = np.bincount(row, chars[end] - chars[start], minlength=n).astype(np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(symbol[data])])
    prefix = HASH.prefix(data)
    # lines
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.searchsorted(np.concatenate([breaks, [len(data)]]), line_start)
    line_end = np.concatenate([breaks, [len(data)]])[line_end]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.minimum(line_end, offsets[line_row + 1])
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    _, again = repeated(line_row, HASH.ranges(prefix, line_start, line_end))
    n_dup_lines = np.bincount(line_row[again], minlength=n)
    # windows of words
    word = HASH.ranges(prefix, start, end)
    m = len(word) - WINDOW + 1
    covered = np.zeros(len(word) + 1, np.int64)
    if m > 0:
        window = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            window = mix(window * np.uint64(0x9E3779B97F4A7C15) + word[k : k + m] + np.uint64(1))
        whole = np.flatnonzero(row[:m] == row[WINDOW - 1 :])
        twice, _ = repeated(row[whole], window[whole])
        at = whole[twice]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    n_repeat = np.bincount(row[np.cumsum(covered)[:-1] > 0], minlength=n)
    return [n_words, word_chars, symbols[offsets[1:]] - symbols[offsets[:-1]], n_dup_lines, n_repeat]


def scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The script of most letters of each row, ``none`` without letters."""
    n, width = len(offsets) - 1, len(SCRIPTS) + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(n), np.diff(chars))
    counts = np.bincount(row * width + script_codes()[points], minlength=width * n).reshape(-1, width)[:, 1:]
    return [SCRIPTS[k] if total else "none" for k, total in zip(counts.argmax(1), counts.sum(1), strict=True)]


def fertility(ids: np.ndarray, at: np.ndarray, is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte tokens and the entropy share of each row."""
    n = len(at) - 1
    count = np.diff(at)
    row = np.repeat(np.arange(n), count)
    n_bytes = np.bincount(row, is_byte[ids], minlength=n)
    key = np.sort(row * len(is_byte) + ids)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    own = key[new] // len(is_byte)
    share = times / np.maximum(count[own], 1)
    entropy = np.bincount(own, -share * np.log2(share), minlength=n)
    return count, n_bytes, np.where(count > 1, entropy / np.log2(np.maximum(count, 2)), 1.0)


def remembered_tokens(path: str) -> tuple[WordTokens, np.ndarray]:
    """The vocabulary's encoder and, for each id, whether it is a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())], np.float64)
    return WordTokens(lambda words: flattened(model.encode(words, num_threads=1))), is_byte


def measure(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the base counts and the measures in a struct ``quality``; a column of that name is replaced."""
    path = vocabulary or vocabulary_path(VOCABULARY)

    @F.arrow_udf(SPARK_MEASURES)
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, is_byte = kept_in_worker("quality", path, remembered_tokens)
        for column in batches:
            data, offsets = utf8(column)
            parts = []
            for i, j in slices(offsets):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                counts = base_counts(own, at)
                ids, places = text_ids(column[i:j], tokens)
                n_tokens, n_bytes, entropy = fertility(ids, places, is_byte)
                none = n_tokens == 0
                parts.append(pa.StructArray.from_arrays([*(pa.array(c.astype(np.int64)) for c in counts), pa.array(n_tokens.astype(np.int64)), pa.array(counts[1] / np.maximum(n_tokens, 1), mask=none), pa.array(n_bytes / np.maximum(n_tokens, 1), mask=none), pa.array(entropy, mask=none), pa.array(scripts(own, at))], fields=list(MEASURES)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(MEASURES)))

    return docs.withColumn("quality", measured(F.col(text_col)))


def base_failed(quality: Column) -> Column:
    return (quality["n_words"] < 10) | (100 * quality["n_repeat_words"] > 20 * quality["n_words"])


def in_band(quality: Column, by: Column | None = None, bands: dict[str, tuple[float, float, float]] = BANDS) -> Column:
    """Whether the measures lie in the band of the script, or of ``by``; false without tokens, true for a value without a band."""
    by = quality["script"] if by is None else by
    out = F.lit(True)
    for value, (chars, byte_share, entropy) in bands.items():
        out = F.when(by == value, (quality["chars_per_token"] >= chars) & (quality["byte_share"] <= byte_share) & (quality["entropy_share"] >= entropy)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def learned_bands(measured: DataFrame, by: str) -> DataFrame:
    """(script, ``by``, n_bits, bands): for each measure its least and largest value; the last two are null for all of them."""
    some = measured.where(~base_failed(F.col("quality"))).select(F.col("quality.script").alias("script"), F.coalesce(by, F.lit("")).alias(by), length_bits().alias("n_bits"), *(F.col(f"quality.{c}").alias(c) for c in LEAST_SPREAD))
    quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(c) for c in LEAST_SPREAD]
    levels = [some.groupBy("script", *keys).agg(F.count("*").alias("n"), *quartiles) for keys in ((), (by,), (by, "n_bits"))]
    out = levels[0].unionByName(levels[1], True).unionByName(levels[2], True).where(F.col("n") >= LEAST_TEXTS)

    def fence(c: str) -> Column:
        low, middle, high = (F.get(c, F.lit(i)) for i in range(3))
        half = FENCE * F.greatest((high - low) / 1.349, F.lit(LEAST_SPREAD[c]))
        return F.struct((middle - half).alias("least"), (middle + half).alias("most")).alias(c)

    return out.select("script", by, "n_bits", F.struct(*map(fence, LEAST_SPREAD)).alias("bands"))


def length_bits() -> Column:
    return F.floor(F.log2(F.greatest(F.col("quality.n_tokens"), F.lit(1)))).cast("int")


def in_learned_band(measured: DataFrame, bands: DataFrame, by: str) -> DataFrame:
    """``measured`` with a column ``in_learned``: whether the measures lie in the closest band there is; true without one.

    The bands are found for each script, ``by`` and length that occur, and then looked up by the rows."""
    script, of, bits, key, size, band_col = (fresh(n, measured.columns) for n in ("script_key", "by_key", "bits_key", "band_key", "band_rows", "band"))
    keys = {script: F.col("quality.script"), of: F.coalesce(by, F.lit("")), bits: length_bits()}
    rows = measured.withColumns(keys).withColumn(key, F.concat_ws("\x01", *keys))
    found = rows.groupBy(key, *keys).agg(F.count("*").alias(size))
    # the closest bands first: of script, ``by`` and length, of the first two, of the script
    levels = {fresh(f"level_{n}", found.columns): tuple(keys)[:n] for n in (3, 2, 1)}
    names = dict(zip(keys, ("script", by, "n_bits"), strict=True))
    for level, own_keys in levels.items():
        own = bands.where(F.col(by).isNotNull() == (of in own_keys)).where(F.col("n_bits").isNotNull() == (bits in own_keys))
        found = found.join(own.select(*(F.col(names[k]).alias(k) for k in own_keys), F.col("bands").alias(level)), list(own_keys), "left")
    band = F.col(band_col)
    found = materialise(found.select(key, F.coalesce(*levels).alias(band_col), size), "quality-bands")
    inside = F.lit(True)
    for c in LEAST_SPREAD:
        inside = inside & F.col(f"quality.{c}").between(band[c]["least"], band[c]["most"])
    out = looked_up(rows, key, found, size, measured.count())
    return out.withColumn("in_learned", F.coalesce(inside, band.isNull())).select(*[c for c in measured.columns if c.lower() != "in_learned"], "in_learned")


def verdicts(docs: DataFrame, by: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` without their texts, with ``quality`` and whether it is kept; columns named ``quality``, ``kept`` and ``in_learned`` are replaced, others stay."""
    measured = materialise(measure(docs, text_col).drop(text_col), "quality")
    q = F.col("quality")
    out = in_learned_band(measured, learned_bands(measured, by), by)
    return out.withColumn("kept", ~base_failed(q) & in_band(q) & F.col("in_learned")).drop("in_learned")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(text_frame(spark, sf_dir, "doc_id", "text", "lang"))
    q = F.col("quality")
    counts = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    more = [q[c].alias(c) for c in ("script", "chars_per_token", "byte_share", "entropy_share")]
    return out.select("doc_id", *counts, base_failed(q).alias("base_failed"), "kept", *more)
