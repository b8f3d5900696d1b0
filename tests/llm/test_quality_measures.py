"""The quality measures and bands beside a plain computation, and columns that stay as they are."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalloom.llm import quality
from evalloom.llm.common import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, _key string, _script string, _band string, _by string, _bits string, _rows string, band string, band_key string, in_learned string, _one string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "one", *(" ".join(f"word{(i * j) % 53} thing{(i + j) % 29}" for j in range(20 + i % 7)) for i in range(130)), "日本語 の 文章 です", "x " * 40, "zq" * 300]
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, *"abcdefghij") for i, t in enumerate(texts)], SCHEMA)


def test_other_columns_stay(docs):
    out = quality.verdicts(docs)
    assert [c for c in docs.columns if c not in ("text", "in_learned")] + ["quality", "kept"] == [c for c in out.columns if c != "in_learned"]
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all((r["_key"], r["_script"], r["_band"], r["_by"], r["_bits"], r["_rows"], r["band"], r["band_key"]) == tuple("abcdefgh") for r in rows)


def test_text_column_by_any_name(docs):
    named = docs.select("doc_id", "lang", F.col("text").alias("body"), F.lit("kept as it is").alias("text"))
    out = quality.verdicts(named, text_col="body")
    assert "body" not in out.columns and {r.text for r in out.collect()} == {"kept as it is"}


def test_measures_beside_plain_computation(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(quality.VOCABULARY))
    for r in quality.measure(docs).collect():
        words = (r.text or "").split()
        # words are encoded each for itself
        ids = [i for w in words for i in model.encode(w)]
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_tokens) == (len(words), sum(map(len, words)), len(ids))
        if not ids:
            assert q.chars_per_token is None and q.byte_share is None and q.entropy_share is None
            continue
        n = len(ids)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        assert abs(q.chars_per_token - q.word_chars / n) < 1e-9
        assert abs(q.byte_share - sum(model.is_byte(i) for i in ids) / n) < 1e-9
        assert abs(q.entropy_share - (entropy / math.log2(n) if n > 1 else 1.0)) < 1e-9


def test_bands_beside_plain_computation(docs):
    measured = quality.measure(docs)
    rows = [r for r in measured.select("lang", "quality").collect() if not (r.quality.n_words < 10 or 100 * r.quality.n_repeat_words > 20 * r.quality.n_words)]
    by_script = {}
    for r in rows:
        by_script.setdefault(r.quality.script, []).append(r.quality)
    learned = {r.script: r.bands for r in quality.learned_bands(measured, "lang").where("lang is null and n_bits is null").collect()}
    assert set(learned) == {s for s, qs in by_script.items() if len(qs) >= quality.LEAST_TEXTS} == {"latin"}
    for name, least in quality.LEAST_SPREAD.items():
        values = sorted(getattr(q, name) for q in by_script["latin"])
        # percentile_approx gives values that are there
        low, middle, high = (values[max(0, math.ceil(p * len(values)) - 1)] for p in (0.25, 0.5, 0.75))
        half = quality.FENCE * max((high - low) / 1.349, least)
        band = learned["latin"][name]
        assert abs(band.least - (middle - half)) < 1e-9 and abs(band.most - (middle + half)) < 1e-9
