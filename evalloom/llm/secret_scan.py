"""Secret scans by password guess cost.

The base patterns (assignments, access keys, long hex runs) always give their spans. The method then
weighs each value that stands in a credential context - what is assigned to a password, token or key
name, a bearer token, the password part of a URL - by the least number of guesses, in bits, that a
segmentation of it into dictionary words (common passwords, then the words of a public vocabulary), dates, repeats, keyboard walks, separators and brute-force characters needs.
A value at or above ``min_bits`` adds a span of kind ``guess``; placeholders such as ``changeme``, ``xxxxxx`` or
``${DATABASE_PASSWORD}`` and references such as ``getConfig().getToken()`` stay below it.

Defined cases: a null text is empty and has no spans; an empty table gives an empty result; repeated rows give
equal results; spans that are equal count once; other columns are kept, one named ``into`` is replaced; offsets count code
points, ends are exclusive. Repeats and walks may be of any length and end anywhere along their run; a run keeps
the few starts that can still be the cheapest, so a very long value costs time in proportion to its length.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import bounded_batches, text_frame, vocabulary_path
from evalloom.llm.spans import SPANS, digest_columns, ordered
from evalloom.llm.word_tokens import kept_in_worker

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "guess")
MIN_BITS = 40.0

# The base patterns.
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# The method's contexts.
CONTEXT = re.compile(r"(?:[Pp][Ww][Dd]|[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd]|[Pp][Hh][Rr][Aa][Ss][Ee])?|[Ss][Ee][Cc][Rr][Ee][Tt](?:_?[Kk][Ee][Yy])?|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]|[Cc][Rr][Ee][Dd][Ee][Nn][Tt][Ii][Aa][Ll])[\"']?\x20*[:=]\x20*[\"']?([^\s\"',;]{6,})")
BEARER = re.compile(r"[Bb][Ee][Aa][Rr][Ee][Rr]\x20+([A-Za-z0-9._~+/=-]{12,})")
USERINFO = re.compile(r"://[^\s/@:]+:([^\s/@]{4,})@")
#: A text without one of these, lowered, has no assignment and no context.
CUES = ("passw", "secret", "token", "api", "pwd", "pass", "access", "credential")

# Common words and passwords, the most frequent first; a word's guess number is its place.
WORDS = """password secret token get key api config env your here replace with secrets environ admin welcome login master dragon monkey letmein qwerty football baseball
sunshine princess shadow superman batman trustno iloveyou charlie michael jordan hunter killer george
computer internet server database system default guest root user test demo example sample dummy change
changeme change_me me my access private public process service account client settings hello world summer winter spring
autumn flower orange purple yellow silver golden cookie cheese coffee ginger pepper hammer soccer hockey
tiger eagle falcon phoenix ranger thunder matrix freedom whatever nothing none null true false placeholder
redacted hidden todo fixme insert value string name pass the and for from this that not""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: Whose words, of three to twenty letters, follow those above in the order of its ids.
VOCABULARY = "word_bpe_49k.json"
LETTERS = re.compile("([a-z]{3,20})</w>")
# Characters that stand for letters.
LEET = str.maketrans("@4301!$57", "aaeoiisst")
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (y, x) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)
DATE_BITS, YEAR_BITS = math.log2(365 * 120), math.log2(120)
# what stands between words, alone or in pairs that open and close references and templates
SEPARATORS = {"_", "-", ".", "<", ">", "(", ")", "[", "]", "{", "}", "$", "%", ":", "/"}
PAIRS = {"${", "$(", "{{", "}}", "()", "<%", "%>", "::"}
SEPARATOR_BITS = math.log2(3)
CLASS_BITS = {"digit": math.log2(10), "lower": math.log2(26), "upper": math.log2(26), "other": math.log2(33), "wide": 12.0}


def char_bits(c: str) -> float:
    if c > "\x7f":
        return CLASS_BITS["wide"]
    return CLASS_BITS["digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "other"]


def adjacent(a: str, b: str) -> bool:
    if a not in PLACE or b not in PLACE:
        return False
    (y, x), (v, u) = PLACE[a], PLACE[b]
    return (y, x) != (v, u) and abs(y - v) <= 1 and abs(x - u) <= 1


def dictionary(path: str) -> dict[str, int]:
    """The ranks of the common words and of a public vocabulary's."""
    rank = dict(RANK)
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    for piece in sorted(ids, key=ids.__getitem__):
        if m := LETTERS.fullmatch(piece):
            rank.setdefault(m[1], len(rank) + 1)
    return rank


def variation(word: str, low: str, plain: str) -> float:
    """The bits of how a dictionary word is written: one for a first capital or all capitals, else one a capital, and one for each character that stands for a letter."""
    changed = sum(x != y for x, y in zip(low, plain, strict=True))
    capitals = sum(x != y for x, y in zip(word, low, strict=True))
    regular = capitals == sum(x.isalpha() for x in low) or (capitals == 1 and word[0] != low[0])
    return changed + (1 if capitals and regular else capitals)


def guess_bits(value: str, rank: dict[str, int] = RANK) -> tuple[float, list[tuple[str, int, int]]]:
    """The least bits of a segmentation of ``value``, and its segments (kind, start, end).

    Each segment costs two bits for its kind besides its own guesses; a run of brute-force characters
    costs the sum of its characters' bits.
    """
    n, low, longest = len(value), value.lower(), 20
    if len(low) != n:
        low = value
    plain = low.translate(LEET)
    cost = [char_bits(c) for c in value]
    best, back = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    brute, brute_from = math.inf, 0
    # repeats: how far the period runs, and for each place in it the starts with what they cost but for their length
    runs = {size: 0 for size in (1, 2, 3, 4)}
    starts: dict[int, list[list[tuple[int, float]]]] = {size: [[] for _ in range(size)] for size in runs}
    walk_from, walk = 0, (math.inf, 0)

    def relax(j: int, bits: float, kind: str, i: int) -> None:
        if bits < best[j]:
            best[j], back[j] = bits, (i, kind)

    for j in range(n + 1):
        if j:
            if best[j - 1] + 2.0 < brute:
                brute, brute_from = best[j - 1] + 2.0, j - 1
            brute += cost[j - 1]
            relax(j, brute, "brute", brute_from)
            for size in runs:
                if j <= size or value[j - 1] != value[j - 1 - size]:
                    if runs[size]:
                        starts[size] = [[] for _ in range(size)]
                    runs[size] = 0
                    continue
                runs[size] += 1
                least = max(3, 2 * size)
                i, here = j - least, starts[size][j % size]
                if runs[size] >= least - size:
                    bits = best[i] + 2.0 + sum(cost[i : i + size])
                    # an older start only gains on a newer one as the repeat grows
                    if all(bits + math.log2(least // size) < b + math.log2((j - a) // size) for a, b in here):
                        here.append((i, bits))
                for a, b in here:
                    relax(j, b + math.log2((j - a) // size), "repeat", a)
            if j == 1 or not adjacent(low[j - 2], low[j - 1]):
                walk_from, walk = j - 1, (math.inf, 0)
            if j - 4 >= walk_from:
                walk = min(walk, (best[j - 4] - 1.5 * (j - 4), j - 4))
                relax(j, walk[0] + 2.0 + math.log2(47) + 1.5 * (j - 1), "walk", walk[1])
        if m := DATE.match(value, j):
            if m.end() - j > 4:
                relax(m.end(), best[j] + 2.0 + DATE_BITS, "date", j)
            if value[j : j + 2] in ("19", "20") and YEAR.match(value, j):
                relax(j + 4, best[j] + 2.0 + YEAR_BITS, "date", j)
        if j < n and value[j] in SEPARATORS:
            relax(j + 1, best[j] + 2.0 + SEPARATOR_BITS, "separator", j)
        if value[j : j + 2] in PAIRS:
            relax(j + 2, best[j] + 2.0 + SEPARATOR_BITS, "separator", j)
        for k in range(j + 3, min(n, j + longest) + 1):
            if place := rank.get(plain[j:k]):
                relax(k, best[j] + 2.0 + math.log2(place + 1) + variation(value[j:k], low[j:k], plain[j:k]), "word", j)
    out, j = [], n
    while j:
        i, kind = back[j]
        out.append((kind, i, j))
        j = i
    return best[n], out[::-1]


def find_secrets(text: str | None, min_bits: float = MIN_BITS, rank: dict[str, int] = RANK) -> list[tuple[str, int, int]]:
    """All spans of one text, in order."""
    text = text or ""
    spans: list[tuple[str, int, int]] = []
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    values: list[tuple[int, int]] = []
    if any(c in low for c in CUES):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        values += [m.span(1) for m in CONTEXT.finditer(text)]
    if "bearer" in low:
        values += [m.span(1) for m in BEARER.finditer(text)]
    if "://" in text:
        values += [m.span(1) for m in USERINFO.finditer(text)]
    spans += [("guess", i, j) for i, j in values if guess_bits(text[i:j], rank)[0] >= min_bits]
    return ordered(spans, KINDS)


def scan(docs: DataFrame, text_col: str = "text", into: str = "secrets", min_bits: float = MIN_BITS, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with an array ``into`` of spans (kind, start, end); a column of that name is replaced."""

    path = vocabulary or vocabulary_path(VOCABULARY)
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(SPANS)
    def scan_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rank = kept_in_worker("secrets", path, dictionary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for column in batches:
            yield pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(t.as_py(), min_bits, rank)] for t in column], kind)

    return docs.withColumn(into, scan_texts(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(scan(text_frame(spark, sf_dir, "doc_id", "text")), "secrets", BASE_KINDS)
