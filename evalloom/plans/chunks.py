"""Queries over chunks by sections and paragraphs, over case files, collections, and runs compared and replayed as stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators import experiments as X
from evalloom.operators import imports, indexing, passages
from evalloom.operators.collections import Collections
from evalloom.plans import catalog, comparisons, oracle
from evalloom.sources.scratch import shared_folder, written
from evalloom.sources.tables import numbered_lines, table

Q, SQL = {}, {}


def query(name: str, sql: str):
    def add(make):
        Q[name], SQL[name] = make, sql
        return make

    return add


# Documents whose every third line becomes a heading of level 1, 2 or 3, and documents whose lines are paragraphs.
SIZE, OVERLAP, LEAST = 500, 50, 80
HEADED_SQL = "array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: case when (i - 1) % 3 = 0 then repeat('#', (1 + (i - 1) // 3 % 3)::int) || ' ' || l else l end), chr(10))"
SPACED_SQL = "replace(text, chr(10), chr(10) || chr(10))"
INK = "length(trim(substr({t}, {a} + 1, {b} - {a}), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
LINES_SQL = """docs as (select doc_id, {text} t from documents where text <> ''), l0 as (select doc_id, t, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) i from docs),
 lines as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint s from l0),
 spans as (select *, least(s + length(line) + 1, length(t)) e, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' inked from lines)"""
HEADS_SQL = """heads as (select *, length(regexp_extract(line, '^(#{1,6})\\s+(.*)$', 1)) lvl, trim(regexp_extract(line, '^(#{1,6})\\s+(.*)$', 2)) title from spans where regexp_matches(line, '^#{1,6}\\s+.*$')),
 path as (select *, last_value(case when lvl = 1 then title end ignore nulls) over w t1, last_value(case when lvl = 2 then title end ignore nulls) over w t2 from heads window w as (partition by doc_id order by i)),
 b0 as (select doc_id, t, s a, coalesce(lead(s) over (partition by doc_id order by i), length(t)) b, case lvl when 1 then title when 2 then t1 || ' / ' || title else t1 || ' / ' || t2 || ' / ' || title end title from path),
 blocks as (select *, row_number() over (partition by doc_id order by a) k from b0 where """ + INK.format(t="t", a="a", b="b") + " > 0)"
# a run of lines with ink is a paragraph
PARAGRAPHS_SQL = """g0 as (select *, i - row_number() over (partition by doc_id order by i) g from spans where inked), ps as (select doc_id, t, min(s) a, max(e) b from g0 group by doc_id, t, g)"""
BLOCKS_SQL = "blocks as (select doc_id, t, a, b, '' title, row_number() over (partition by doc_id order by a) k from ps)"
# blocks go together until there is ink enough; the last ones go to the one before; long ones are cut at paragraphs
CHUNKED_SQL = f"""grown as (select doc_id, t, k, a, b, title, 1::bigint g from blocks where k = 1 union all select n.doc_id, n.t, n.k, case when {INK.format(t="n.t", a="o.a", b="o.b")} < {LEAST} then o.a else n.a end, n.b, case when {INK.format(t="n.t", a="o.a", b="o.b")} < {LEAST} then o.title else n.title end,
 case when {INK.format(t="n.t", a="o.a", b="o.b")} < {LEAST} then o.g else o.g + 1 end from grown o join blocks n on n.doc_id = o.doc_id and n.k = o.k + 1),
 whole as (select * from grown qualify k = max(k) over (partition by doc_id, g)), short as (select doc_id, b, g from whole where g > 1 and {INK.format(t="t", a="a", b="b")} < {LEAST} and g = (select max(g) from whole w where w.doc_id = whole.doc_id)),
 joined as (select w.doc_id, w.t, w.a, coalesce(s.b, w.b) b, w.title from whole w left join short s on s.doc_id = w.doc_id and s.g = w.g + 1 where (w.doc_id, w.g) not in (select doc_id, g from short)),
 large as (select * from joined where b - a > {SIZE}), inner_lines as (select l.doc_id, l.t, l.a block, l.title, s.i, s.s, least(s.e, l.b) e from large l join spans s on s.doc_id = l.doc_id and s.s >= l.a and s.s < l.b and s.inked),
 ig as (select *, i - row_number() over (partition by doc_id, block order by i) g from inner_lines), ip as (select doc_id, t, block, title, min(s) a, max(e) b, row_number() over (partition by doc_id, block order by min(s)) k from ig group by doc_id, t, block, title, g),
 fill as (select *, a oa, 1::bigint og from ip where k = 1 union all select n.*, case when n.b - o.oa <= {SIZE} then o.oa else n.a end, case when n.b - o.oa <= {SIZE} then o.og else o.og + 1 end from fill o join ip n on n.doc_id = o.doc_id and n.block = o.block and n.k = o.k + 1),
 packs as (select doc_id, t, title, oa a, max(b) b from fill group by doc_id, t, block, title, og, oa),
 cut as (select doc_id, t, title, a, b, unnest(range(case when b - a <= {SIZE} then 1 else ceil((b - a - {SIZE}) / {SIZE - OVERLAP}.0)::bigint + 1 end)) w from packs),
 chunks as (select doc_id, t, title, a, b from joined where b - a <= {SIZE} union all select doc_id, t, title, a + w * {SIZE - OVERLAP}, least(a + w * {SIZE - OVERLAP} + {SIZE}, b) from cut)
 select doc_id, row_number() over (partition by doc_id order by a) - 1 "index", a char_start, b char_end, title section, sha256(substr(t, a + 1, b - a)) digest from chunks where {INK.format(t="t", a="a", b="b")} > 0"""


def headed(s: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (1 + F.floor(i / 3) % 3).cast("int")), F.lit(" "), l)).otherwise(l))
    return table(s, d, "documents").where("text <> ''").select("doc_id", F.array_join(lines, "\n").alias("text"))


@query("section_chunks", "with recursive " + LINES_SQL.format(text=HEADED_SQL) + ", " + HEADS_SQL + ", " + CHUNKED_SQL)
def section_chunks(s: SparkSession, d: str) -> DataFrame:
    return passages.chunk_rows(headed(s, d)).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("index", "char_start", "char_end")), "section", F.sha2("text", 256).alias("digest"))


@query("paragraph_chunks", "with recursive " + LINES_SQL.format(text=SPACED_SQL) + ", " + PARAGRAPHS_SQL + ", " + BLOCKS_SQL + ", " + CHUNKED_SQL)
def paragraph_chunks(s: SparkSession, d: str) -> DataFrame:
    """By the table function that SQL has."""
    passages.register_functions(s)
    spaced = table(s, d, "documents").where("text <> ''").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return s.sql(f"select d.doc_id, bigint(c.index) index, bigint(c.char_start) char_start, bigint(c.char_end) char_end, c.section, sha2(c.text, 256) digest from {{docs}} d, lateral document_chunks(d.text, 'paragraph', {SIZE}, {OVERLAP}, {LEAST}) c", docs=spaced)


# Runs as stored, each pair with its outcome: a copy, another order of ids, other metrics, other settings, other data, an unfinished run.
STORED = {"base": (60, "h1", 1, "succeeded"), "copy": (60, "h1", 1, "succeeded"), "turned": (60, "h1", 1, "succeeded"), "other": (64, "h1", 1, "succeeded"), "settings": (60, "h2", 1, "succeeded"), "data": (60, "h2", 2, "failed"), "failed": (60, "h1", 1, "failed"), "tokens": (60, "h1", 1, "succeeded"), "fewer": (60, "h1", 1, "succeeded")}
PAIRS = [("base", "copy", False), ("base", "turned", False), ("base", "turned", True), ("base", "other", False), ("base", "settings", False), ("base", "data", False), ("base", "failed", False), ("base", "tokens", False), ("fewer", "base", False)]


def stored_cases(s: SparkSession, d: str) -> DataFrame:
    """(run_id, qid, metrics, flags, ids) of all runs, from two searches."""
    found = catalog.searched(s, d, 60)
    parts = []
    for dims in (60, 64):
        ids = catalog.hits(s, d, dims, 5, found).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
        m = catalog.flagged(s, d, dims, 5, found=found).join(ids, "qid")
        metrics = F.map_filter(F.create_map(*[x for c in ("recall", "hits", "first_hit_rank") for x in (F.lit(c), F.col(c).cast("double"))]), lambda _, v: v.isNotNull())
        parts.append(m.select(F.lit(dims).alias("dims"), "qid", metrics.alias("metrics"), "flags", "ids"))
    runs = F.explode(F.array(*(F.struct(F.lit(name).alias("run_id"), F.lit(v[0]).alias("of")) for name, v in STORED.items())))
    rows = parts[0].unionByName(parts[1]).select("*", runs.alias("run")).where((F.col("dims") == F.col("run.of")) & ((F.col("run.run_id") != "fewer") | (F.col("qid") % 100 != 0)))
    return written(rows.select("run.run_id", "qid", "metrics", "flags", F.when(F.col("run.run_id") == "turned", F.reverse("ids")).otherwise(F.col("ids")).alias("ids")), "runs")


def told(run: tuple[str, tuple], tokens: int = 100) -> str:
    return f"('{run[0]}', '{run[1][1]}', {run[1][2]}, '{run[1][3]}', {tokens + (run[0] == 'tokens')})"


OUTCOMES_SQL = oracle.GOLD + ", " + oracle.run("a", 60, 5) + ", " + oracle.run("b", 64, 5) + ", " + oracle.flagged("fa", "a", 5) + ", " + oracle.flagged("fb", "b", 5) + f""", runs(run_id, config_hash, dataset_id, status, tokens) as (values {", ".join(map(told, STORED.items()))}),
 pairs(pair, l, r, strict) as (values {", ".join(f"({n}, '{a}', '{b}', {str(c).lower()})" for n, (a, b, c) in enumerate(PAIRS))}),
 met as (select fa.qid, fa.recall is distinct from fb.recall and not coalesce(abs(fa.recall - fb.recall) <= 1e-9, false) or fa.hits is distinct from fb.hits or fa.first_hit_rank is distinct from fb.first_hit_rank or fa.flags <> fb.flags changed, ia.ids <> ib.ids turned, len(ia.ids) > 1 and ia.ids <> list_reverse(ia.ids) turns
  from fa join fb using (qid) join (select qid, list(vec_id order by rank) ids from a_r group by 1) ia using (qid) join (select qid, list(vec_id order by rank) ids from b_r group by 1) ib using (qid)),
 reasons as (select p.*, case when a.config_hash <> b.config_hash and a.dataset_id <> b.dataset_id then 'config,data' when a.config_hash <> b.config_hash then 'config' when a.dataset_id <> b.dataset_id then 'data' when a.status <> 'succeeded' or b.status <> 'succeeded' then 'status' else '' end reasons, case when a.tokens <> b.tokens then 'tokens' else '' end runs_differ from pairs p join runs a on a.run_id = l join runs b on b.run_id = r),
 counted as (select pair, strict, reasons, case when reasons = '' then runs_differ else '' end run_differences, case when reasons = '' and r = 'other' then (select count(*) filter (changed) from met) else 0 end case_diffs, case when reasons <> '' then 0 when r = 'other' then (select count(*) filter (turned) from met) when r = 'turned' then (select count(*) filter (turns) from met) else 0 end order_diffs,
  0::bigint only_in_left, case when l = 'fewer' then (select count(*) filter (qid % 100 = 0) from met) else 0 end only_in_right from reasons)"""


@query("consistency_outcomes", f"with {OUTCOMES_SQL} select *, case when reasons <> '' then 2 when run_differences <> '' or case_diffs + only_in_left + only_in_right > 0 or (strict and order_diffs > 0) then 1 else 0 end exit_code from counted")
def consistency_outcomes(s: SparkSession, d: str) -> DataFrame:
    cases = stored_cases(s, d)
    totals = cases.groupBy("run_id").agg(F.avg(F.col("metrics")["recall"]).alias("mean"))
    settings = F.create_map(*[x for n, v in STORED.items() for x in (F.lit(n), F.struct(F.lit(v[1]).alias("config_hash"), F.lit(v[2]).alias("dataset_id"), F.lit(v[3]).alias("status")))])
    # a run's metrics: here what its cases have in common with the base run's, and its tokens
    run = totals.select("run_id", settings[F.col("run_id")].alias("s")).select("run_id", F.struct("run_id", "s.config_hash", "s.dataset_id", F.lit(1).alias("corpus_id"), "s.status", F.create_map(F.lit("tokens"), F.when(F.col("run_id") == "tokens", 101.0).otherwise(100.0)).alias("metrics")).alias("run"))
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("pair"), F.lit(a).alias("l"), F.lit(b).alias("r"), F.lit(c).alias("strict")) for n, (a, b, c) in enumerate(PAIRS))))
    pairs = s.range(1).select(named.alias("p")).select("p.*")
    pairs = pairs.join(run.select(F.col("run_id").alias("l"), F.col("run").alias("left")), "l").join(run.select(F.col("run_id").alias("r"), F.col("run").alias("right")), "r").select("pair", "strict", "left", "right")
    out = X.consistency_outcomes(pairs, cases)
    return out.withColumn("reasons", F.array_join("reasons", ",")).withColumn("run_differences", F.array_join("run_differences", ","))


REPLAY_SQL = comparisons.BOTH + """, stored as (select 1 run_id, 1 k, l.*, list_filter(l.flags, lambda x: x not in ('hallucination', 'off_topic', 'generation_quality', 'no_claims', 'anchor_incomplete')) old from l union all select 2, 5, r.*, list_filter(r.flags, lambda x: x not in ('hallucination', 'off_topic', 'generation_quality', 'no_claims', 'anchor_incomplete')) from r)"""


@query("attribution_replayed", REPLAY_SQL + " select run_id, qid, k, array_to_string(old, ',') old_flags, array_to_string(flags, ',') new_flags, list_sort(old) <> list_sort(flags) changed from stored")
def attribution_replayed(s: SparkSession, d: str) -> DataFrame:
    """Flags stored before anything was judged, made again with the judgements; the second run's k comes from what its cases retrieved."""
    rows = [df.withColumn("run_id", F.lit(n)).withColumn("k", F.lit(k)) for n, (df, k) in enumerate(zip(comparisons.stored_runs(s, d), (1, 5), strict=True), 1)]
    judged = ("hallucination", "off_topic", "generation_quality", "no_claims", "anchor_incomplete")
    metrics = F.struct("gold_count", F.col("k").alias("retrieved_count"), "hits", "recall", "hit", "first_hit_rank")
    results = rows[0].unionByName(rows[1]).select("run_id", "qid", metrics.alias("metrics"), "judge", F.filter("flags", lambda f: ~f.isin(*judged)).alias("flags"))
    runs = results.select("run_id").distinct().withColumn("top_k", F.when(F.col("run_id") == 1, 1))
    return X.replayed(results, runs).withColumn("old_flags", F.array_join("old_flags", ",")).withColumn("new_flags", F.array_join("new_flags", ","))


# A file a source, of JSON lines with planted faults.
def case_lines(s: SparkSession, d: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("doc_id") % 20
    anchor = F.array(F.struct(F.when(n == 7, " ").when(n == 8, "no-such").otherwise(F.concat(F.lit("d"), i.cast("string"))).alias("doc"), F.substring("text", 1, 20).alias("span")))
    qid = F.when(n == 2, "  ").when(n == 11, "again").otherwise(F.concat(F.lit("q"), i.cast("string")))
    body = F.to_json(F.struct(qid.alias("qid"), F.when(n.isin(2, 3), "").otherwise(F.col("text")).alias("question"), F.when(n != 9, anchor).alias("gold_anchors"), F.when(n == 5, "hard").when(n == 6, "易").alias("difficulty")))
    value = F.when(n == 0, "").when(n == 1, "{broken").when(n == 4, F.concat(F.lit('{"qid": "x'), i.cast("string"), F.lit('", "question": "y", "gold_anchors": 3}'))).when(n == 10, "[1, 2]").otherwise(body)
    # dealt by ranges, in order: a source's lines are parts of its file, written by as many tasks as it takes
    docs = table(s, d, "documents").where("text is not null").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", "text")
    return docs.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id").select("source", "doc_id", value.alias("value"))


IMPORT_SQL = """i0 as (select coalesce(source, 'none') source, doc_id, doc_id % 20 n, text, row_number() over (partition by coalesce(source, 'none') order by doc_id) line from documents where text is not null),
 i1 as (select *, case when n = 11 then 'again' else 'q' || doc_id end qid, case n when 1 then ['no JSON object'] when 10 then ['no JSON object'] when 2 then ['no qid', 'no question'] when 3 then ['no question'] when 4 then ['anchors aren''t a list'] when 5 then ['bad difficulty'] when 7 then ['anchor without doc: 0'] else [] end
  || case when n not in (0, 1, 2, 3, 4, 10) and trim(text, ' ' || chr(9) || chr(10)) = '' then ['no question'] else [] end form from i0 where n <> 0),
 i2 as (select *, len(form) = 0 and doc_id % 3 = 0 and n <> 11 stored, len(form) = 0 and n = 8 lost from i1), firsts as (select qid, min(source || '/' || lpad(line::varchar, 9, '0')) f from i2 where len(form) = 0 and not stored and not lost group by 1),
 i3 as (select source, line, case when len(form) > 0 then form else list_filter([case when stored then 'stored qid' end, case when source || '/' || lpad(line::varchar, 9, '0') > f then 'repeated qid' end, case when lost then 'no such document: no-such' end], lambda x: x is not null) end errors from i2 left join firsts using (qid))"""


@query("cases_imported", f"with {IMPORT_SQL} select source, line, array_to_string(errors, '; ') errors from i3 where len(errors) > 0")
def cases_imported(s: SparkSession, d: str) -> DataFrame:
    return imported_cases(s, d).where(F.size("errors") > 0).select("source", "line", F.array_join("errors", "; ").alias("errors"))


@query("import_totals", f"with {IMPORT_SQL} select source, count(*) total, count(*) filter (len(errors) = 0) imported, count(*) filter (len(errors) > 0) refused from i3 group by 1")
def import_totals(s: SparkSession, d: str) -> DataFrame:
    return imports.totals(imported_cases(s, d)).withColumnRenamed("file", "source")


def imported_cases(s: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_folder(s)}/evalloom-tables/cases-{uuid.uuid4().hex}"
    case_lines(s, d).select("source", "value").write.partitionBy("source").text(folder)
    named = numbered_lines(s, folder, parts=True).withColumn("source", F.regexp_extract("file", "source=([^/]*)$", 1)).withColumn("file", F.col("source"))
    stored = table(s, d, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("qid"))
    docs = table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"))
    return imports.checked(written(imports.parsed(named), "cases"), stored, docs)


@query("collection_upserted", "select vec_id::varchar point_id, case when vec_id % 3 = 0 then -embedding[1] else embedding[1] end::double \"first\", 64::bigint dims, (select count(*) from embeddings) points from embeddings")
def collection_upserted(s: SparkSession, d: str) -> DataFrame:
    """All points, then every third again with its vector turned round, and some a third time as they were."""
    kept = Collections(s, f"{shared_folder(s)}/evalloom-tables/collections-{uuid.uuid4().hex}")
    kept.ensure("corpus1_5f45e034", 64)
    points = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("point_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    turned = points.where(F.col("point_id").cast("long") % 3 == 0).withColumn("embedding", F.transform("embedding", lambda x: -x))
    for part in (points, turned, points.where(F.col("point_id").cast("long") % 3 == 1)):
        kept.upsert("corpus1_5f45e034", part)
    info = kept.info("corpus1_5f45e034")
    return kept.read("corpus1_5f45e034").crossJoin(F.broadcast(info)).select("point_id", F.get("embedding", F.lit(0)).alias("first"), F.col("dims").cast("long").alias("dims"), "points")


NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
WHOLE_SQL = "blocks as (select doc_id, t, 0::bigint a, length(t) b, '' title, 1::bigint k from docs)"
FIXED_SQL = "with recursive " + LINES_SQL.format(text="text") + ", " + WHOLE_SQL + ", " + CHUNKED_SQL
POINT_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
FIXED_HASH = indexing.chunking_hash("fixed", SIZE, OVERLAP, LEAST)


@query("corpus_indexed", f"""select doc_id doc, count(*) points, sum(char_end - char_start)::bigint chars, min({POINT_SQL}) first_id, 'corpus7_{FIXED_HASH[:8]}' "collection", (select count(*) from documents) docs
 from (select *, sha1(unhex('{NAMESPACE}') || encode('7:' || doc_id || ':' || "index" || ':{FIXED_HASH}')) h from ({FIXED_SQL})) group by 1""")
def corpus_indexed(s: SparkSession, d: str) -> DataFrame:
    """Documents indexed twice: the collection is as after the first time."""
    kept = Collections(s, f"{shared_folder(s)}/evalloom-tables/collections-{uuid.uuid4().hex}")
    docs = table(s, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    for _ in range(2):
        name, report = indexing.index_corpus(kept, 7, docs, NAMESPACE, "fixed", SIZE, OVERLAP, LEAST)
    out = kept.read(name).groupBy("doc").agg(F.count("*").alias("points"), F.sum(F.length("text")).alias("chars"), F.min("point_id").alias("first_id"), F.max("collection").alias("collection"))
    return out.crossJoin(F.broadcast(report.select("docs")))
