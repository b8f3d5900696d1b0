"""Token ids of texts by way of their words: each different word goes to a tokeniser once."""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evalloom.llm.common import trim

#: Words, and stems of words, that a worker remembers with their ids; beyond, it starts anew.
REMEMBERED = 350_000
STEMS = 900_000
#: Words that go to the tokeniser in one text.
JOINED = 5_000

#: The ids of all words, one after another, and how many each has.
Encoded = tuple[np.ndarray, np.ndarray]


def flattened(lists: list[list[int]]) -> Encoded:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(count.sum())), count


def grown(array: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n values, at least doubled if it had less."""
    if n <= len(array):
        return array
    out = np.empty(max(n, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class WordTokens:
    """Encodes words in whole batches and remembers them, their ids in flat arrays."""

    def __init__(self, encode: Callable[[list[str]], Encoded], remembered: int = REMEMBERED) -> None:
        self.encode, self.remembered = encode, remembered
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 0
        self.flat, self.begin, self.count = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def places(self, words: list[str]) -> np.ndarray:
        """Each word's place in ``begin`` and ``count``, which say where its ids are in ``flat``."""
        if len(self.known) > self.remembered:
            self.forget()
        known = self.known
        at = [known.get(w, -1) for w in words]
        if new := list(dict.fromkeys(w for w, i in zip(words, at, strict=True) if i < 0)):
            ids, count = self.encode(new)
            n, end = len(known), self.used + len(ids)
            self.flat = grown(self.flat, end)
            self.begin, self.count = grown(self.begin, n + len(new)), grown(self.count, n + len(new))
            self.flat[self.used : end] = ids
            self.begin[n : n + len(new)] = self.used + np.cumsum(count) - count
            self.count[n : n + len(new)] = count
            self.used = end
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            at = [known[w] if i < 0 else i for w, i in zip(words, at, strict=True)]
        return np.array(at, np.int64)

    def of(self, words: list[str], word: np.ndarray, edges: np.ndarray) -> Encoded:
        """The ids of texts made of the words with numbers ``word``, text i those from edges[i] on; and where each text's ids begin."""
        at = self.places(words)[word] if len(word) else word.astype(np.int64)
        count = self.count[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(count)])
        return self.flat[ragged(self.begin[at], count)], ends[edges]


_KEPT: dict[tuple[str, str], object] = {}


def kept_in_worker(kind: str, path: str, make: Callable[[str], object]) -> object:
    """What ``make`` gives for a path, one for a Python worker whatever the number of tasks it runs."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = make(path)
    return _KEPT[kind, path]


def give_back() -> None:
    """Called by tasks without use for remembered words: their worker's memory is for other work now."""
    gc.enable()
    if _KEPT:
        _KEPT.clear()
        trim()


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ..., count[i] of them, for each i."""
    total = int(count.sum())
    out = np.ones(total, np.int64)
    some = count > 0
    first = start[some]
    at = np.cumsum(count[some])[:-1]
    if total:
        out[0] = first[0]
        out[at] = first[1:] - (first[:-1] + count[some][:-1] - 1)
    return np.cumsum(out)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For each text where its words begin in the list of all words; the number of each word; the different words.

    Words are what ASCII white space separates. Nulls have none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values[offsets[0] : offsets[-1]].dictionary_encode() if len(lists) else pa.array([], pa.string()).dictionary_encode()
    return offsets - (offsets[0] if len(offsets) else 0), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def text_ids(texts: pa.Array, tokens: WordTokens) -> Encoded:
    """The ids of all texts, one after another, and the n + 1 places where each text's begin."""
    offsets, word, different = words_of(texts)
    return tokens.of(different, word, offsets)


#: Words of letters that no normal form changes, with punctuation after them.
LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")


def cuts_latin(tokenizer: object) -> bool:
    """Whether a tokenizer lowers text and takes such a word as its letters and then its punctuation, whatever stands before."""
    rules = json.loads(tokenizer.to_str())
    normal, pre = json.dumps(rules["normalizer"]), json.dumps(rules["pre_tokenizer"])
    return '"Lowercase"' in normal and "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in pre and '"add_prefix_space": false' in pre


def json_tokenizer(path: str) -> Callable[[list[str]], Encoded]:
    """The encoder of a tokenizers file; no threads of its own, no special tokens added.

    Many words go in one text with spaces between them; the ids' places in it say which word they are of.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def joined(words: list[str]) -> Encoded:
        flat, count = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(words), JOINED):
            part = words[i : i + JOINED]
            start = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            found = tokenizer.encode(" ".join(part), add_special_tokens=False)
            flat.append(np.array(found.ids, np.uint32))
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            count.append(np.bincount(np.searchsorted(start, at, side="right") - 1, minlength=len(part)).astype(np.int64))
        return np.concatenate(flat), np.concatenate(count)

    if not cuts_latin(tokenizer):
        return joined
    parts_known = WordTokens(joined, STEMS)

    def by_parts(words: list[str]) -> Encoded:
        number: dict[str, int] = {}
        part: list[int] = []
        edges = [0]
        for w in words:
            if m := LATIN.fullmatch(w):
                part.append(number.setdefault(m[1].lower(), len(number)))
                if m[2]:
                    part.append(number.setdefault(m[2], len(number)))
            else:
                part.append(number.setdefault(w, len(number)))
            edges.append(len(part))
        ids, at = parts_known.of(list(number), np.array(part, np.int64), np.array(edges))
        return ids, np.diff(at)

    return by_parts
