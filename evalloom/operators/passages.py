"""Documents to chunks, anchors to chunks, chunks to prompts, answers to claims."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADING = re.compile(r"(#{1,6})\s+(.*)")


def fixed_spans(length: Column, size: int, overlap: int) -> Column:
    """Starts of windows of ``size`` that advance by size - overlap until the end is reached."""
    step = size - overlap
    n = F.when(length <= size, 1).otherwise(F.ceil((length - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step)


def fixed_chunks(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, index, char_start, char_end, text) of sliding windows over each text that isn't blank."""
    spans = docs.where(F.length(text) > 0).select(id_col, text, F.posexplode(fixed_spans(F.length(text), size, overlap)).alias("index", "char_start"))
    return spans.select(id_col, F.col("index").cast("long").alias("index"), F.col("char_start").cast("long").alias("char_start"), F.least(F.col("char_start") + size, F.length(text)).cast("long").alias("char_end"), F.substring(text, F.col("char_start") + 1, F.lit(size)).alias("text"))


Span = tuple[int, int]
STRATEGIES = ("headings", "fixed", "paragraph")


def lines_of(raw: str) -> list[tuple[int, int, str]]:
    """(start, end, line) of each line, with what ends it."""
    lines = raw.splitlines(keepends=True)
    ends = list(accumulate(map(len, lines)))
    return list(zip([0, *ends], ends, lines, strict=False))


def sections(raw: str) -> list[tuple[int, int, str]]:
    """(start, end, path of titles) of what stands between headings of a markdown text and isn't blank."""
    heads = [(start, len(m[1]), m[2].strip()) for start, _, line in lines_of(raw) if (m := HEADING.match(line.rstrip("\r\n")))]
    under = accumulate(heads, lambda path, h: [*(p for p in path if p[1] < h[1]), h], initial=[])
    cuts = [0, *(h[0] for h in heads), len(raw)]
    return [(a, b, " / ".join(p[2] for p in path)) for a, b, path in zip(cuts, cuts[1:], under, strict=False) if raw[a:b].strip()]


def paragraphs(raw: str) -> list[Span]:
    """Runs of lines that aren't blank."""
    runs = (list(run) for inked, run in groupby(lines_of(raw), key=lambda line: bool(line[2].strip())) if inked)
    return [(run[0][0], run[-1][1]) for run in runs]


def windows(start: int, end: int, size: int, overlap: int) -> list[Span]:
    """Windows that advance by size - overlap until one reaches the end."""
    n = max(0, -(-(end - start - size) // (size - overlap))) + 1
    return [(s, min(s + size, end)) for s in range(start, start + n * (size - overlap), size - overlap)]


def packed(spans: list[Span], size: int, overlap: int) -> Iterator[Span]:
    """As many spans together as ``size`` holds; a longer one by windows."""
    ends, i = [b for _, b in spans], 0
    while i < len(spans):
        after = bisect_right(ends, spans[i][0] + size, lo=i)
        yield from [(spans[i][0], ends[after - 1])] if after > i else windows(*spans[i], size, overlap)
        i = max(after, i + 1)


def long_enough(blocks: list[tuple[int, int, str]], raw: str, least: int) -> list[tuple[int, int, str]]:
    """Blocks put together until each has ``least`` characters between its first and last ink, with the title of the first; what is left at the end goes to the one before."""
    begin = [a + len(raw[a:b]) - len(raw[a:b].lstrip()) for a, b, _ in blocks]
    ink = [a + len(raw[a:b].rstrip()) for a, b, _ in blocks]
    firsts, i = [], 0
    while i < len(blocks):
        firsts.append(i)
        i = bisect_left(ink, begin[i] + least, lo=i) + 1
    if len(firsts) > 1 and ink[-1] - begin[firsts[-1]] < least:
        firsts.pop()
    return [(blocks[i][0], blocks[j - 1][1], blocks[i][2]) for i, j in zip(firsts, [*firsts, len(blocks)][1:], strict=True)]


def check_chunking(strategy: str, size: int, overlap: int, least: int) -> None:
    if strategy not in STRATEGIES or size <= 0 or not 0 <= overlap < size or least < 0:
        raise ValueError(f"bad chunking: {strategy}, {size}, {overlap}, {least}")


def chunk_spans(raw: str, strategy: str = "headings", size: int = 500, overlap: int = 50, least: int = 80) -> list[tuple[int, int, str]]:
    """(start, end, section) of a text's chunks: its sections, its paragraphs or the whole of it, short ones of the first two together, long ones cut at paragraphs."""
    if strategy == "fixed":
        blocks = [(0, len(raw), "")]
    else:
        blocks = long_enough(sections(raw) if strategy == "headings" else [(a, b, "") for a, b in paragraphs(raw)], raw, least)
    out = []
    for a, b, title in blocks:
        parts = [(a, b)] if b - a <= size else [(a + s, a + e) for s, e in packed(paragraphs(raw[a:b]), size, overlap)]
        out += [(s, e, title) for s, e in parts if raw[s:e].strip()]
    return out


def chunk(raw: str, strategy: str = "headings", size: int = 500, overlap: int = 50, least: int = 80) -> list[dict]:
    """The chunks of one text as rows."""
    check_chunking(strategy, size, overlap, least)
    return [{"index": n, "text": raw[a:b], "char_start": a, "char_end": b, "section": title} for n, (a, b, title) in enumerate(chunk_spans(raw, strategy, size, overlap, least))]


class ChunkTable:
    """A table function of a text and its chunking."""

    def eval(self, text: str, strategy: str, size: int, overlap: int, least: int):
        for c in chunk(text or "", strategy, size, overlap, least):
            yield c["index"], c["text"], c["char_start"], c["char_end"], c["section"]


chunk_table = F.udtf(ChunkTable, returnType="index: int, text: string, char_start: int, char_end: int, section: string")


def register_functions(spark: SparkSession) -> None:
    """Makes ``document_chunks(text, strategy, size, overlap, least)`` known to SQL, for use with LATERAL."""
    spark.udtf.register("document_chunks", chunk_table)


#: Characters of texts that a task cuts at a time (a longer text alone).
SLICE_CHARS = 1 << 20
CHUNK_FIELDS = [T.StructField(n, t) for n, t in (("index", T.IntegerType()), ("text", T.StringType()), ("char_start", T.IntegerType()), ("char_end", T.IntegerType()), ("section", T.StringType()))]


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of a batch's rows with their texts, so that a task holds the chunks of ``SLICE_CHARS`` characters, whatever a batch has."""
    for batch in batches:
        # by bytes, of which a text has at least as many
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, filled = 0, 0
        for i, size in enumerate([*sizes, None]):
            if i > start and (size is None or filled + size > SLICE_CHARS):
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(text).to_pylist()]
                start, filled = i, 0
            filled += size or 0


def chunk_columns(texts: list[str], strategy: str, size: int, overlap: int, least: int) -> tuple[list[int], list[pa.Array]]:
    """How many chunks each text has, and the columns of all of them."""
    spans = [chunk_spans(raw, strategy, size, overlap, least) for raw in texts]
    each = [(n, raw[a:b], a, b, title) for raw, of in zip(texts, spans, strict=True) for n, (a, b, title) in enumerate(of)]
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
    return [len(of) for of in spans], [pa.array([x[k] for x in each], kind) for k, kind in enumerate(kinds)]


def chunk_rows(docs: DataFrame, text: str = "text", strategy: str = "headings", size: int = 500, overlap: int = 50, least: int = 80) -> DataFrame:
    """A row for each chunk of ``docs``, beside the document's other columns."""
    check_chunking(strategy, size, overlap, least)
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*docs.select(*kept).schema.fields, *CHUNK_FIELDS])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, len(kept)):
            counts, made = chunk_columns(texts, strategy, size, overlap, least)
            if sum(counts):
                at = pa.array([i for i, n in enumerate(counts) for _ in range(n)], pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(kept))), *made], names=schema.names)

    return docs.select(*kept, text).mapInArrow(rows, schema)


def chunked(docs: DataFrame, text: str = "text", strategy: str = "headings", size: int = 500, overlap: int = 50, least: int = 80) -> DataFrame:
    """``docs`` with an array ``chunks``."""
    check_chunking(strategy, size, overlap, least)
    schema = T.StructType([*docs.schema.fields, T.StructField("chunks", T.ArrayType(T.StructType(CHUNK_FIELDS)))])
    place, names = docs.columns.index(text), [f.name for f in CHUNK_FIELDS]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, place):
            counts, made = chunk_columns(texts, strategy, size, overlap, least)
            chunks = pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), pa.StructArray.from_arrays(made, names=names))
            yield pa.RecordBatch.from_arrays([*batch.columns, chunks], names=schema.names)

    return docs.mapInArrow(listed, schema)


#: Characters of a block of spans that one automaton looks for, and blocks for which texts are read again.
BLOCK_CHARS, BLOCKS = 2 << 20, 8
#: Spans shorter than this are looked for one by one.
SHORT = 4


def holding(items: DataFrame, docs: DataFrame, block_chars: int = BLOCK_CHARS, blocks: int = BLOCKS) -> DataFrame:
    """(qid, doc, span) of the documents (doc, text) whose text holds an item's whole span. An empty span is held by none.

    As long as the spans are few (``blocks`` of ``block_chars`` characters together, which is measured) they go to all
    tasks, as automata that find all spans of a block in one pass over a text; more of them are joined by words."""
    spans = items.where(F.length("span") > 0).select("qid", "span")
    each = F.length("span") + 64
    chars = spans.agg(F.sum(each)).first()[0] or 0
    if chars > block_chars * blocks:
        return held_by_words(spans, docs)
    rows, parts, filled = spans.orderBy("span", "qid").collect(), [[]], 0
    for r in rows:
        if filled and filled + len(r.span) + 64 > block_chars:
            parts, filled = [*parts, []], 0
        parts[-1].append((r.qid, r.span))
        filled += len(r.span) + 64
    out = [_held(part, docs, items) for part in parts]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def _held(spans: list[tuple], docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold spans (qid, span), by one pass of an automaton over each text."""
    schema = T.StructType([items.schema["qid"], docs.schema["doc"], T.StructField("span", T.StringType())])
    by = docs.sparkSession.sparkContext.broadcast(spans)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of: dict[str, list[int]] = {}
        for n, (_, span) in enumerate(by.value):
            of.setdefault(span, []).append(n)
        automaton = ahocorasick.Automaton()
        for span in of:
            if len(span) >= SHORT:
                automaton.add_word(span, span)
        automaton.make_automaton()
        few = [span for span in of if len(span) < SHORT]
        kinds = [pa.int64() if f.dataType == T.LongType() else None for f in schema]
        for batch in batches:
            n, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = {span for _, span in automaton.iter(text)} if text and len(automaton) else set()
                for span in [*found, *(s for s in few if s in (text or ""))]:
                    n += of[span]
                    at += [i] * len(of[span])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([by.value[k][0] for k in n], kinds[0]), batch.column(0).take(pa.array(at)), pa.array([by.value[k][1] for k in n])], names=schema.names)

    return docs.select("doc", "text").mapInArrow(scan, schema)


def held_by_words(items: DataFrame, docs: DataFrame) -> DataFrame:
    """What ``holding`` gives, for any number of spans.

    Candidates share three words from inside the span: words with white space on both sides stay words whatever
    stands around the span. Spans with fewer such words go by their first four characters, shorter ones by the
    first. Only hashes and ids are joined; texts are fetched for candidates alone."""
    inner = F.split("span", r"\s+")
    spans = items.where(F.length("span") > 0).select("qid", "span", inner.alias("w"))
    long, short = F.size("w") >= 5, F.length("span") >= 4
    three = lambda w: F.xxhash64(*w)
    text_words = docs.select("doc", F.split("text", r"\s+").alias("w")).where(F.size("w") >= 3)
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"), F.slice("w", 3, F.size("w")).alias("c"))
    by_words = text_words.select("doc", F.explode(F.array_distinct(F.transform(zipped, lambda x: three((x["a"], x["b"], x["c"]))))).alias("key"))
    near = spans.where(long).select("qid", "span", three([F.get("w", F.lit(i)) for i in (1, 2, 3)]).alias("key")).join(by_words, "key")

    def grams_of(n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, F.lit(n))))

    for wanted, n in ((~long & short, 4), (~long & ~short, 1)):
        by_grams = docs.where(F.length("text") >= n).select("doc", F.explode(grams_of(n)).alias("key"))
        near = near.unionByName(spans.where(wanted).select("qid", "span", F.substring("span", 1, n).alias("gram")).join(by_grams.withColumnRenamed("key", "gram"), "gram").select(F.xxhash64("gram").alias("key"), "qid", "span", "doc"))
    candidates = near.select("qid", "span", "doc").distinct()
    return candidates.join(docs, "doc").where(F.contains(F.col("text"), F.col("span"))).select("qid", "doc", "span")


# The punctuation that doesn't count when texts are compared loosely.
PUNCTUATION = "#*`>:-—、,，。.；;!！?？()（）[]【】\"'“”‘’"


def normalized(text: Column) -> Column:
    """Lower case without white space and the punctuation above."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s" + re.escape(PUNCTUATION) + "]+", ""))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def anchored(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, doc, span, level, point) of the chunks that hold an anchor's span, at the first level that finds any:
    1 in the section's title, 2 in the text, 3 in the normalised text or title; a blank span is all chunks, level 0.

    Only chunks of documents with an anchor that is nowhere as it stands are normalised, each once."""
    anchors = anchors.select("qid", "doc", "span", stripped(F.col("span")).alias("_s"))
    met = anchors.join(chunks, "doc")
    level = F.when(F.col("_s") == "", 0).when(F.contains(F.col("section"), F.col("_s")), 1).when(F.contains(F.col("text"), F.col("_s")), 2)
    found = met.withColumn("level", level).where("level is not null")
    least = F.min("level").over(Window.partitionBy("qid", "doc", "span"))
    plain = found.withColumn("_least", least).where("level = _least").select("qid", "doc", "span", "level", "point")
    key = ["qid", "doc", "span"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"p.{c}")) for c in key]
    open_ = anchors.alias("a").join(plain.select(*key).distinct().alias("p"), same, "left_anti").select("a.*", normalized(F.col("_s")).alias("_loose")).where("_loose <> ''")
    loose = chunks.join(open_.select("doc").distinct(), "doc", "left_semi").select("doc", "point", normalized(F.col("text")).alias("_text"), normalized(F.col("section")).alias("_section"))
    third = open_.join(loose, "doc").where(F.contains(F.col("_text"), F.col("_loose")) | F.contains(F.col("_section"), F.col("_loose")))
    return plain.unionByName(third.select(*key, F.lit(3).alias("level"), "point"))


def context(ranked: Column, budget: int, separator: int = 2) -> Column:
    """Greedy packing of an array of (rank, text) in order: a block that doesn't fit is passed over, later ones may fit."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("ranks"))

    def step(state: Column, block: Column) -> Column:
        cost = F.length(block["text"]) + F.when(state["used"] > 0, separator).otherwise(0)
        fits = state["used"] + cost <= budget
        return F.when(fits, F.struct((state["used"] + cost).alias("used"), F.concat(state["ranks"], F.array(block["rank"].cast("int"))).alias("ranks"))).otherwise(state)

    return F.aggregate(ranked, start, step)


TOKEN = re.compile(r'''[ \t\n\r]*(?:(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<value>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|-?Infinity|NaN|true|false|null)|(?P<mark>[][{}:,]))''', re.ASCII)
#: Deepest nesting of an object that counts.
NESTING = 500
# what may come next: inside a list or an object after its start, a comma, a key or a colon, and after a value
FOLLOWS = {"[": {"value", "]"}, "[,": {"value"}, "{": {"key", "}"}, "{,": {"key"}, "{key": {":"}, "{:": {"value"}, "[value": {",", "]"}, "{value": {",", "}"}}


def whole_objects(text: str, start: int) -> tuple[list[tuple[int, int]], list[int], int]:
    """Reads JSON from a brace until it ends or breaks: the (start, end) of the objects that are whole by then, the
    braces inside strings, and the place where reading ended. One pass, whatever the nesting."""
    stack: list[list] = []  # kind, start, deepest nesting inside, what came last
    done, hidden, at = [], [], start
    while m := TOKEN.match(text, at):
        kind, mark = m.lastgroup, m["mark"]
        allowed = FOLLOWS[stack[-1][0] + stack[-1][3]] if stack else {"value"}
        if kind == "mark" and mark in "]}":
            if mark not in allowed:
                break
            opened, begun, deep, _ = stack.pop()
            if opened == "{" and deep < NESTING:
                done.append((begun, m.end()))
            if not stack:
                at = m.end()
                break
            stack[-1][2] = max(stack[-1][2], deep + 1)
            stack[-1][3] = "value"
        elif kind == "mark" and mark in ",:":
            if mark not in allowed:
                break
            stack[-1][3] = mark
        elif kind == "mark":
            if "value" not in allowed:
                break
            stack.append([mark, m.start("mark"), 0, ""])
        elif kind == "string" and "key" in allowed:
            stack[-1][3] = "key"
        elif "value" in allowed and stack:
            stack[-1][3] = "value"
        else:
            break
        if kind == "string":
            hidden += [m.start("string") + i for i in range(len(m["string"])) if m["string"][i] == "{"] if "{" in m["string"] else []
        at = m.end()
    return done, hidden, at


def first_object(answer: str | None) -> str | None:
    """The first object in a text that is whole, as JSON. Where reading from a brace breaks, objects inside that were
    whole before count, and no brace that was open then is tried again; those inside strings are."""
    text = answer or ""
    at = text.find("{")
    while at >= 0:
        done, hidden, end = whole_objects(text, at)
        first = min(done, default=None)
        before = [h for h in hidden if first is None or h < first[0]]
        for h in before:
            inside, _, _ = whole_objects(text, h)
            if found := [d for d in inside if d[0] == h]:
                first = found[0]
                break
        if first:
            return json.dumps(json.loads(text[slice(*first)]), ensure_ascii=False, sort_keys=True)
        at = text.find("{", max(end, at + 1))
    return None


def extract_object(answer: Column) -> Column:
    @F.pandas_udf("string")
    def extracted(answers: pd.Series) -> pd.Series:
        return answers.map(first_object)

    return extracted(answer)


def claims(answers: DataFrame, answer: str = "answer", most: int = 20) -> DataFrame:
    """``answers`` with the claims of each: renumbered, at most ``most``, and an error where they break the protocol."""
    parsed = F.from_json(extract_object(F.col(answer)), "claims array<struct<text:string,label:string,evidence:string,reason:string>>")
    out = answers.withColumn("_p", parsed)
    listed = F.col("_p.claims")
    bad = F.exists(listed, lambda c: F.coalesce(F.trim(c["text"]) == "", F.lit(True)) | ~F.coalesce(c["label"].isin("supported", "unsupported", "irrelevant"), F.lit(False)))
    error = F.when(listed.isNull(), "no claims").when(bad, "bad claim")
    numbered = F.transform(F.slice(listed, 1, most), lambda c, i: F.struct((i + 1).alias("id"), F.trim(c["text"]).alias("text"), c["label"].alias("label")))
    return out.select(*answers.columns, F.when(error.isNull(), numbered).alias("claims"), F.greatest(F.size(listed) - most, F.lit(0)).alias("truncated"), error.alias("error"))
