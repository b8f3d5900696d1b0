"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits, scheme separators and
cue words of identifiers. From each anchor a deterministic parser expands to the left and right, validates,
and sets the span's bounds: e-mail addresses, IPv4 addresses, card numbers (Luhn), telephone numbers, and,
beyond these base kinds, IBANs (modulo 97), account numbers after a cue, social security numbers after a
cue, and user names with passwords in URLs.

Defined cases: a null text is empty and has no spans; base kinds are leftmost and non-overlapping within
their kind, and a failing match is dropped without a retry inside it; repeated rows give equal results; an
empty table gives an empty result; a text of any length is scanned whole; other columns are kept, one named
``into`` is replaced; offsets count code points, ends are exclusive. Spans of different kinds may overlap; ``redact`` replaces
each maximal covered stretch once, under the kind that starts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import text_frame
from evalloom.llm.spans import SPANS, digest_columns, ordered

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account", "ssn", "userinfo")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[\x20:#=]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"(?:\x20?(?:[Nn]o|[Nn]umber|[Nn]r)\b)?[.\x20:#=]*([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9])")
SSN = re.compile(r"[\x20:#=]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
USERINFO = re.compile(r"([^\s/@:]+:[^\s/@]+)@")
#: Cue words, each also capitalised and in capitals, and the parser they call.
CUES = {"iban": IBAN, "account": ACCOUNT, "acct": ACCOUNT, "ssn": SSN}


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "@+0123456789":
        found.add_word(c, "0" if c in DIGITS else c)
    found.add_word("://", "://")
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            found.add_word(form, cue)
    found.make_automaton()
    return found


def digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid_iban(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find_personal(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text, in order."""
    spans: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = 0
    for last, what in automaton().iter(text or ""):
        if what == "0":
            if last >= card_end and (m := CARD.match(text, last)):
                card_end = m.end()
                number = digits(m[0])
                if 14 <= len(number) <= 19 and luhn(number):
                    spans.append(("card", last, card_end))
            if last >= ip_end and (last == 0 or text[last - 1] not in DIGITS) and (m := QUAD.match(text, last)):
                ip_end = m.end()
                if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in (g.lstrip("0") or "0" for g in m.groups())):
                    spans.append(("ip", last, ip_end))
        elif what == "@":
            start = last
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                email_end = m.end()
                spans.append(("email", start, email_end))
        elif what == "+":
            if last >= phone_end and (m := PHONE.match(text, last)):
                phone_end = m.end()
                if 10 <= len(digits(m[0])) <= 15:
                    spans.append(("phone", last, phone_end))
        elif what == "://":
            if m := USERINFO.match(text, last + 1):
                spans.append(("userinfo", *m.span(1)))
        elif m := CUES[what].match(text, last + 1):
            if what == "iban":
                # the longest prefix that validates: what follows may be a word in capitals
                code, end = m[1], m.end(1)
                while len(code) >= 15 and not valid_iban(code):
                    code, end = code[:-1], end - 1
                if len(code) >= 15:
                    spans.append(("iban", m.start(1), end))
            else:
                spans.append(("ssn" if what == "ssn" else "account", *m.span(1)))
    return ordered(spans, KINDS) if spans else spans


def redact_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each maximal covered stretch replaced by its first kind in angle brackets."""
    if text is None or not spans:
        return text
    out, done, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[done:start], f"<{kind.upper()}>"]
        done = end
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, text_col: str = "text", into: str = "personal") -> DataFrame:
    """``docs`` with an array ``into`` of spans (kind, start, end); a column of that name is replaced."""

    @F.arrow_udf(SPANS)
    def scan_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for column in batches:
            yield pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_personal(t.as_py())] for t in column], kind)

    return docs.withColumn(into, scan_texts(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in its texts replaced by <EMAIL>, <IP>, <CARD> and so on; nulls stay null."""

    @F.arrow_udf("string")
    def redact_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([redact_text(t, find_personal(t)) for t in (x.as_py() for x in column)], pa.string())

    return docs.withColumn(text_col, redact_texts(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(scan(text_frame(spark, sf_dir, "doc_id", "text")), "personal", BASE_KINDS)
