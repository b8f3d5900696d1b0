"""Words of any length by the piece search: as one after another, and in time in proportion to their length."""

import random
import time

import numpy as np
import pytest

from evalloom.llm import sentencepieces
from evalloom.llm.common import vocabulary_path


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Pieces(vocabulary_path(sentencepieces.VOCABULARY))


def one_by_one(pieces, word):
    back, piece = pieces.segment(np.frombuffer(word.encode("utf-32-le"), np.uint32)[None, :])
    out, at = [], len(word)
    while at:
        i = int(piece[at, 0])
        out.extend([i] if i >= 0 else [pieces.bytes[x] for x in reversed(word[at - 1].encode())])
        at -= int(back[at, 0])
    return out[::-1]


MAKE = {
    "han": lambda n: "▁" + "".join(chr(random.randint(0x4E00, 0x5FFF)) for _ in range(n)),
    "letters": lambda n: "▁" + "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)),
    "one letter": lambda n: "a" * n,
    "spaces": lambda n: "▁" * n,
    "mixed": lambda n: "".join(random.choice(["the", "ing", "é", "日本", "😀", "0"]) for _ in range(n)),
}


@pytest.mark.parametrize("kind", MAKE)
@pytest.mark.parametrize("n", [1, 39, 40, 41, 200, 777])
def test_windows_give_the_same_pieces(pieces, monkeypatch, kind, n):
    monkeypatch.setattr(sentencepieces, "WINDOW", 40)
    random.seed(n)
    word = MAKE[kind](n)
    ids, many = pieces.encode_long(word)
    assert ids.tolist() == one_by_one(pieces, word) and many.tolist() == [len(ids)]


def test_words_of_about_equal_length_advance_together(pieces, monkeypatch):
    monkeypatch.setattr(sentencepieces, "ALONE", 300)
    random.seed(7)
    words = [make(random.randint(1, 400)) for _ in range(20) for make in MAKE.values()]
    ids, many = pieces.encode(words)
    edges = np.concatenate([[0], np.cumsum(many)])
    for word, a, b in zip(words, edges[:-1], edges[1:], strict=True):
        assert ids[a:b].tolist() == one_by_one(pieces, word)


def test_long_words_take_little_time(pieces):
    word = MAKE["han"](100_000)
    began = time.time()
    pieces.encode([word])
    assert time.time() - began < 6  # more than a hundred before


def test_long_texts_round_trip(spark):
    random.seed(2)
    texts = [MAKE["han"](30_000)[1:], "a" * 50_000, "x y " + "é" * 9_000 + " z", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.decoded for r in sentencepieces.decode(sentencepieces.encode(docs)).collect()}
    assert [out[i] for i in range(5)] == texts
