"""The stages of the pipeline on odd rows, on an empty table and with other columns."""

import corpus_pipeline
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, slice_no string"
BODY = " ".join(f"word{i % 61} thing{i % 47} and some more of it" for i in range(60))
OTHER = " ".join(f"quite another number {i * 7 % 1000} of lines here" for i in range(60))


def stages():
    return dict(corpus_pipeline.STAGES)


@pytest.fixture
def odd(spark):
    texts = [None, "", " \n", BODY, BODY, BODY + " end", OTHER, "mail a@b.co now", "1234 5678", "long text " * 40_000]
    rows = [(i, t, "en" if i > 2 else None, None, None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3]], COLUMNS)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize("name", stages())
def test_empty_table(spark, name):
    out = stages()[name](spark, spark.createDataFrame([], COLUMNS), "")
    assert out.count() == 0


def test_language_id(spark, odd):
    out = stages()["language_id"](spark, odd, "")
    assert ids(out) == [3, 3, 4, 5, 6, 7, 9] and out.columns == list(corpus_pipeline.COLUMNS)


def test_near_duplicates(spark, odd):
    out = stages()["near_duplicates"](spark, odd, "")
    found = ids(out)
    assert found == [0, 1, 2, 3, 6, 7, 8, 9] and out.columns == list(corpus_pipeline.COLUMNS)


def test_repeated_passages(spark, odd):
    out = stages()["repeated_passages"](spark, odd, "")
    texts = {r.doc_id: r.text for r in out.collect()}
    assert out.count() == 11 and out.columns == list(corpus_pipeline.COLUMNS)
    assert (texts[0], texts[1], texts[2], texts[3], texts[4], texts[6]) == (None, "", " \n", "", "", OTHER)
    assert texts[5] == " end" and texts[9] == "" and {r.doc_id: r.n_chars for r in out.collect()}[5] == 4


def test_personal_data(spark, odd):
    texts = {r.doc_id: r.text for r in stages()["personal_data"](spark, odd, "").collect()}
    assert texts[7] == "mail <EMAIL> now" and texts[0] is None and texts[3] == BODY


def test_packing(spark, odd):
    out = stages()["packing"](spark, odd, "").toPandas()
    assert set(out.doc_id) == set(range(10)) and (out[out.doc_id.isin([0, 1, 2])].length == 1).all()
    assert (out.groupby("sequence_id").length.sum() <= 2048).all() and out[out.doc_id == 9].piece.max() > 0
