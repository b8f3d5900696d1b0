"""What each operator gives for nulls, empty texts, repeated rows and columns with clashing names."""

import pytest
from evalloom.llm import langid, merkle, packing, pii, quality, secret_scan, sentencepieces, suffixes

BODY = " ".join(f"word{i % 61} thing{i % 47}" for i in range(300))
SCHEMA = "doc_id long, text string, lang string, quality string, personal string, secrets string, fingerprint string, langid string, piece_ids string, kept string, piece string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n", "12 + 3", BODY, BODY, "mail a@b.co, token: Zx9+kQ77pLm2", "Ω" * 50_000]
    rows = [(i, t, "en" if i > 2 else None, *["x"] * 8) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, None, *[None] * 9)], SCHEMA)


def by_id(df, column):
    out = {}
    for r in df.select("doc_id", column).collect():
        out.setdefault(r[0], []).append(r[1])
    return out


def test_pieces(odd):
    out = sentencepieces.decode(sentencepieces.encode(odd))
    ids, texts = by_id(out, "piece_ids"), by_id(out, "decoded")
    assert ids[0] == ids[None] == [None] and ids[1] == [[]] and ids[4][0] == ids[4][1] == ids[5][0]
    assert texts[0] == [None] and texts[1] == [""] and texts[2] == [" \n"] and texts[7] == ["Ω" * 50_000]


def test_secrets(odd):
    found = by_id(secret_scan.scan(odd), "secrets")
    assert found[0] == found[1] == found[4][:1] == [[]] and len(found[4]) == 2
    assert [(s.kind, s.start, s.end) for s in found[6][0]] == [("assign", 13, 32), ("guess", 20, 32)]


def test_personal_data(odd):
    found = by_id(pii.scan(odd), "personal")
    assert found[0] == found[1] == found[7] == [[]] and [(s.kind, s.start, s.end) for s in found[6][0]] == [("email", 5, 11)]
    assert by_id(pii.redact(odd), "text")[0] == [None] and by_id(pii.redact(odd), "kept")[6] == ["x"]


def test_quality(odd):
    found = by_id(quality.measure(odd), "quality")
    assert all(found[i][0].n_words == 0 and found[i][0].script == "none" and found[i][0].chars_per_token is None for i in (0, 1, 2, None))
    assert found[3][0].script == "none" and found[7][0].script == "greek" and found[7][0].word_chars == 50_000 and found[4][0] == found[4][1] == found[5][0]
    assert {i: k[0] for i, k in by_id(quality.verdicts(odd), "kept").items() if i in (0, 1, 2, 3)} == dict.fromkeys((0, 1, 2, 3), False)


def test_fingerprints(odd):
    found = by_id(merkle.fingerprints(odd), "fingerprint")
    assert found[0] == found[1] == found[None] and found[4][0] == found[4][1] == found[5][0] != found[2][0]


def test_languages(odd):
    found = by_id(langid.identify(odd, langid.fit(odd)), "langid")
    assert all((found[i][0].lang, found[i][0].score) == ("und", 0.0) for i in (0, 1, 2, 3)) and found[4][0].lang == "en" and found[4][0] == found[4][1]
    nothing = by_id(langid.identify(odd, langid.fit(odd.where("lang is null"))), "langid")
    assert all(x.lang == "und" for v in nothing.values() for x in v)


def test_pieces_of_documents(odd):
    out = packing.pack(packing.pieces(odd)).toPandas()
    assert (out[out.doc_id.isin([0, 1, 2])].length == 1).all() and out.doc_id.isna().sum() == 1
    assert (out[out.doc_id == 4].groupby("piece").length.count() == 2).all() and (out.groupby("sequence_id").length.sum() <= 2048).all()


def test_repeats(odd):
    out = suffixes.remove_repeats(odd)
    assert by_id(out, "n_removed")[0] == by_id(out, "n_bytes")[0] == [0] and by_id(out, "n_removed")[4] == [len(BODY)] * 2
    assert [bytes(x) for x in by_id(out, "kept")[6]] == [b"mail a@b.co, token: Zx9+kQ77pLm2"] and by_id(out, "n_removed")[7] == [100_000]
