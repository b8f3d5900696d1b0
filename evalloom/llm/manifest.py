"""A Merkle tree over a whole dataset: a root for all rows, one for each group of them, and a proof for each row.

Rows become leaves (SHA-256 in the JVM; texts are read once, and only hashes go on). Leaves are dealt by ranges of
(group, key) into sorted parts, whatever the groups' sizes; counts by part and group give each leaf's place, and with
it the size of each level above. A node is an event at its parent: a partial parent collects its children's digests
by their places until it has as many as the size of the level below says, and then is itself an event one level up;
the last node of a group is one in the tree of the groups. Tasks do this for the leaves they have. What is left
there, the frontier, is a few partial parents a part, and goes to larger and larger regions of parts by
``combineByKey``, which joins the partial parents of one node, until all are whole: 8 regions at a time, each step
written as a table. Parents that weren't whole in a part are linked to it in reverse, with all nodes above them;
along these links the families (a node's children) come back, and each part proves its own leaves: the siblings at
every level, up to the root.

Defined cases: null groups and keys come first; of rows with the same key that with the smaller leaf comes first,
and repeated rows have places of their own; nulls in any column are a leaf's ``-``; a table of one row has its leaf
as root and an empty proof; an empty table gives an empty result; other columns, and texts of any length, are no
matter, as only the named columns are read. A group may have all rows, or each row its own.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm.common import discard, materialise, text_frame

ARITY = 8
#: Most leaves that a part should have, and least if there are enough parts for all tasks.
PART, LEAST_PART = 1 << 16, 1 << 10
#: Regions that a step joins to one.
REGIONS = 8
#: Rows of an Arrow batch that tasks give.
BATCH = 4096
#: The tree over the groups' roots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A node of a tree: the number of its group (or TOP), its level (leaves are 0), its place on the level.
Node = tuple[int, int, int]


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(column: Column) -> Column:
    """A value as it counts in a leaf: its UTF-8 bytes' number, a colon and itself; ``-`` if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def on_level(n: int, level: int) -> int:
    """Nodes on a level of a tree with ``n`` leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def height(n: int) -> int:
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


class Climb:
    """Partial parents of the nodes that a task has met, and the families that became whole."""

    def __init__(self) -> None:
        self.partial: dict[Node, tuple[dict[int, str], int, int]] = {}
        self.whole: dict[Node, list[str]] = {}

    def arrive(self, group: int, level: int, at: int, hashed: str, size: int, groups: int) -> None:
        """A node is known: tells its parent, and goes on with what that makes whole. ``size`` is the number of leaves of its tree."""
        while True:
            if on_level(size, level) == 1:
                if group == TOP:
                    return
                at, group, level, size = group, TOP, 0, groups
                continue
            key = (group, level + 1, at // ARITY)
            children, _, _ = self.partial.setdefault(key, ({}, size, groups))
            children[at % ARITY] = hashed
            if not (done := self.resolved(key)):
                return
            level, at, hashed = level + 1, at // ARITY, done

    def resolved(self, key: Node) -> str | None:
        """The digest of a parent that has all its children, which then isn't partial any more."""
        children, size, _ = self.partial[key]
        if len(children) < min(ARITY, on_level(size, key[1] - 1) - ARITY * key[2]):
            return None
        del self.partial[key]
        self.whole[key] = [children[i] for i in sorted(children)]
        return digest(self.whole[key])

    def join(self, key: Node, children: dict[int, str], size: int, groups: int) -> None:
        """A partial parent from elsewhere."""
        mine, _, _ = self.partial.setdefault(key, ({}, size, groups))
        mine.update(children)
        if done := self.resolved(key):
            self.arrive(key[0], key[1], key[2], done, size, groups)

    def above(self, key: Node) -> Iterator[Node]:
        """A partial parent and all nodes over it."""
        (group, level, at), (_, size, groups) = key, self.partial[key]
        while True:
            yield group, level, at
            if on_level(size, level) > 1:
                level, at = level + 1, at // ARITY
            elif group != TOP and groups > 1:
                group, level, at, size = TOP, 1, group // ARITY, groups
            else:
                return


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def placed(leaves: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (group, key, leaf, ...) in sorted parts, with ``part``, the group's number ``g`` and size ``n``, the number of groups ``gs`` and ``pos``, the place in the group."""
    spark = leaves.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-rows // PART), min(tasks, rows // LEAST_PART))
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("salt")]
    dealt = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    at = dealt.columns.index("group")
    names = pa.schema([("part", pa.int32()), ("nth", pa.int64())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            nth = []
            for group in batch.column(at).to_pylist():
                n = n + 1 if group == now else 0
                now = group
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], names=[*batch.schema.names, *names.names])

    dealt = materialise(dealt.mapInArrow(numbered, dealt.withColumn("part", F.lit(0)).withColumn("nth", F.lit(0).cast("long")).schema), "manifest-leaves")
    # a row for each group in each part: few, but for groups of few rows
    counts = dealt.groupBy("part", "group").agg(F.count("*").alias("n_here"))
    of_group = Window.partitionBy("group").orderBy("part")
    counts = counts.withColumn("before", F.coalesce(F.sum("n_here").over(of_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("n_here").over(Window.partitionBy("group"))).withColumn("first", F.min("part").over(Window.partitionBy("group")))
    counts = materialise(counts, "manifest-counts")
    # groups are numbered in their first part, after those of the parts before it: a row a part in one window
    new = counts.where("part = first").withColumn("nth_group", F.row_number().over(Window.partitionBy("part").orderBy(F.col("group").asc_nulls_first())))
    by_part = new.groupBy("part").agg(F.count("*").alias("groups"))
    one = Window.partitionBy().orderBy("part")
    by_part = by_part.select("part", (F.sum("groups").over(one) - F.col("groups")).alias("groups_before"), F.sum("groups").over(Window.partitionBy()).alias("gs"))
    groups = new.join(by_part, "part").select("group", (F.col("groups_before") + F.col("nth_group") - 1).alias("g"), "gs")
    # the number of a group's first part and its group are what other parts know of it
    known = counts.select("part", F.col("group"), "before", "n").alias("c").join(groups.alias("g"), F.col("c.group").eqNullSafe(F.col("g.group"))).select("c.part", "c.group", "before", "n", "g", "gs")
    known = materialise(known, "manifest-groups")
    discard(counts)
    met = dealt.alias("d").join(known.alias("k"), (F.col("d.part") == F.col("k.part")) & F.col("d.group").eqNullSafe(F.col("k.group")))
    return met.select("d.*", "g", "n", "gs", (F.col("before") + F.col("nth")).alias("pos")), dealt


FRONTIER = "region int, part int, g long, level int, at long, size long, gs long, slots array<int>, digests array<string>"


def frontier(leaves: DataFrame) -> DataFrame:
    """What the tasks that read ``leaves`` can't resolve: partial parents with the part they are of (``slots`` null: only a reverse link)."""
    columns = leaves.select("part", "g", "pos", "leaf", "n", "gs")
    schema = leaves.sparkSession.createDataFrame([], FRONTIER).schema
    arrow = _arrow(schema)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, Climb] = defaultdict(Climb)
        for batch in batches:
            for part, g, pos, leaf, n, gs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts[part].arrive(g, 0, pos, leaf, n, gs)
                parts[part].whole.clear()
        yield from _batches(_unresolved(parts), arrow)

    return columns.mapInArrow(climb, schema)


def _unresolved(parts: dict[int, Climb]) -> Iterator[tuple]:
    for part, c in parts.items():
        links: set[Node] = set()
        for key, (children, size, groups) in c.partial.items():
            yield part, part, *key, size, groups, list(children), list(children.values())
            links.update(c.above(key))
        for key in links:
            yield None, part, *key, 0, 0, None, None


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


FAMILIES = "region int, g long, level int, at long, size long, gs long, slots array<int>, digests array<string>, whole boolean"


def joined(partial: DataFrame, regions: int) -> DataFrame:
    """One step: partial parents of ``REGIONS`` regions meet, those of one node are combined, and what becomes whole climbs on. Gives families and what is left."""

    def pair(r):
        return (r["region"] // REGIONS, (r["g"], r["level"], r["at"])), (dict(zip(r["slots"], r["digests"], strict=True)), r["size"], r["gs"])

    def both(a, b):
        return a[0] | b[0], a[1], a[2]

    def climb(rows):
        regions = defaultdict(Climb)
        for (region, key), (children, size, groups) in rows:
            regions[region].join(key, children, size, groups)
        for region, c in regions.items():
            for key, (children, size, groups) in c.partial.items():
                yield region, *key, size, groups, list(children), list(children.values()), False
            for key, children in c.whole.items():
                yield region, *key, 0, 0, list(range(len(children))), children, True

    met = partial.rdd.map(pair).combineByKey(lambda v: v, both, both, regions, lambda k: k[0])
    return partial.sparkSession.createDataFrame(met.mapPartitions(climb), FAMILIES)


def families_of(partial: DataFrame, parts: int) -> list[DataFrame]:
    """The families of all nodes that no part has whole, a table a step; in the last step all regions are one."""
    out = []
    while True:
        parts = -(-parts // REGIONS)
        step = materialise(joined(partial, parts), "manifest-families")
        out.append(step)
        if parts == 1:
            return out
        partial = step.where("not whole")


PROOFS = "subroot string, root string, siblings array<struct<before:array<string>,after:array<string>>>"


def manifest(df: DataFrame, key: str, group: str, leaf: Column, **carried: Column) -> DataFrame:
    """(key, group, leaf, the carried columns, subroot, root, siblings) of each row of ``df``.

    ``leaf`` is a hash in hexadecimal; ``siblings`` are, from the leaf to the root, the digests before and after the
    row's own node in its family, which ``folded`` takes to the root."""
    kept = df.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf.alias("leaf"), *(c.alias(n) for n, c in carried.items()))
    hashed = materialise(kept, "manifest-hashes")
    leaves, dealt = placed(hashed, hashed.count())
    open_ = materialise(frontier(leaves), "manifest-frontier")
    discard(hashed)
    parts = (dealt.agg(F.max("part")).first()[0] or 0) + 1
    steps = families_of(open_.where("slots is not null").drop("part"), parts)
    whole = steps[0].where("whole")
    for step in steps[1:]:
        whole = whole.unionByName(step.where("whole"))
    node = ["g", "level", "at"]
    links = open_.where("slots is null").select("part", *node).distinct()
    back = links.join(whole.select(*node, "digests"), node)
    out = _proved(leaves, back, list(carried))
    return out.select(F.col("key").alias(key), F.col("group").alias(group), *out.columns[2:])


def _proved(leaves: DataFrame, back: DataFrame, carried: list[str]) -> DataFrame:
    """Leaves with their proofs: a part's families from outside, then its leaves, come to one task."""
    own = leaves.select("part", "g", F.lit(0).alias("level"), F.col("pos").alias("at"), "n", "gs", F.lit(None).cast("array<string>").alias("digests"), "key", "group", "leaf", *carried)
    columns = {c: own.schema[c].dataType for c in ("n", "gs", "key", "group", "leaf", *carried)}
    outside = back.select("part", *("g", "level", "at"), *(F.lit(None).cast(t).alias(c) for c, t in columns.items()), "digests").select(*own.columns)
    tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own.unionByName(outside).repartition(tasks, "part").sortWithinPartitions("part", F.desc("level"), "g", "at")
    given = own.select("key", "group", "leaf", *carried)
    schema = given.sparkSession.createDataFrame([], PROOFS).schema
    arrow, first = _arrow(schema), own.columns.index("key")
    out = type(schema)([*given.schema.fields, *schema.fields])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        climb, known, held, now = Climb(), {}, [], None
        for batch in batches:
            begun = 0
            parts = batch.column(0).to_pylist()
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True))
            leaf = batch.column(first + 2).to_pylist()
            for i, (part, (g, level, at, n, gs, digests)) in enumerate(zip(parts, rows, strict=True)):
                if part != now:
                    if now is not None:
                        held.append((batch.slice(begun, i - begun), rows[begun:i]))
                        yield from proofs(held, climb.whole | known)
                    climb, known, held, now, begun = Climb(), {}, [], part, i
                if level:
                    known[g, level, at] = digests
                else:
                    climb.arrive(g, 0, at, leaf[i], n, gs)
            held.append((batch.slice(begun), rows[begun:]))
        if held:
            yield from proofs(held, climb.whole | known)

    def proofs(held: list, families: dict[Node, list[str]]) -> Iterator[pa.RecordBatch]:
        above: dict[tuple[int, int, int, int], tuple] = {}
        for batch, rows in held:
            for k in range(0, len(rows), BATCH):
                part = [i for i in range(k, min(k + BATCH, len(rows))) if not rows[i][1]]
                if part:
                    some = batch.take(pa.array(part))
                    leaf = some.column(first + 2).to_pylist()
                    got = [path(rows[i], h, families, above) for i, h in zip(part, leaf, strict=True)]
                    yield pa.RecordBatch.from_arrays([*some.columns[first:], *(pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), arrow, strict=True))], names=out.names)

    return rows.mapInArrow(prove, out)


def path(row: tuple, leaf: str, families: dict[Node, list[str]], above: dict) -> tuple[str, str, list[dict]]:
    """Subroot, root and siblings of a leaf. ``above`` remembers what nodes over it have in common."""
    g, _, at, n, gs, _ = row
    return _path(g, 0, at, n, gs, leaf, families, above)


def _path(g: int, level: int, at: int, size: int, gs: int, hashed: str, families: dict, above: dict) -> tuple[str, str, list[dict]]:
    if on_level(size, level) == 1:
        if g == TOP:
            return "", hashed, []
        _, root, siblings = _path(TOP, 0, g, gs, gs, hashed, families, above)
        return hashed, root, siblings
    key = (g, level + 1, at // ARITY)
    if key not in above:
        family = families[key]
        above[key] = family, _path(g, level + 1, at // ARITY, size, gs, digest(family), families, above)
    family, (subroot, root, siblings) = above[key]
    own = at % ARITY
    return subroot, root, [{"before": family[:own], "after": family[own + 1 :]}, *siblings]


def all_siblings(siblings: Column) -> Column:
    """The siblings' digests as one text, level by level and from left to right."""
    return F.array_join(F.flatten(F.transform(siblings, lambda s: F.concat(s["before"], s["after"]))), "")


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings have."""
    up = lambda h, s: F.sha2(F.concat(F.array_join(s["before"], ""), h, F.array_join(s["after"], "")), 256)
    return F.aggregate(siblings, leaf, up)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_frame(spark, sf_dir, *FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    altered = F.when(tampered, leaf_hash(*(fields | {"text": F.translate("text", UPPER, LOWER)}).values()))
    out = manifest(docs, "doc_id", "lang", leaf_hash(*fields.values()), altered=altered)
    out = out.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("siblings")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(all_siblings(F.col("siblings")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELDS_SQL = " || ".join(f"coalesce(strlen(d.{c}::varchar) || ':' || d.{c}::varchar, '-')" for c in FIELDS)
SQL = f"""with recursive bits as (select doc_id, d, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(d, ''), lambda c: ord(c)::bigint)), lambda c, x:
  list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)) c from (select distinct doc_id, doc_id::varchar d from documents)),
 crc as (select doc_id, xor(c, 4294967295) % 3 = 0 hit from bits),
 hashed as (select d.doc_id, d.lang, sha256({_FIELDS_SQL}) leaf, case when hit then sha256({_FIELDS_SQL.replace("d.text::varchar", f"translate(d.text, '{UPPER}', '{LOWER}')")}) end altered from documents d left join crc on d.doc_id is not distinct from crc.doc_id),
 leaves as (select *, row_number() over () id, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by lang) n from hashed),
 nodes as (select lang, 0 lvl, pos k, leaf h, n size from leaves union all select lang, lvl + 1, k // {ARITY}, sha256(string_agg(h, '' order by k)), (size + {ARITY - 1}) // {ARITY} from nodes where size > 1 group by lang, lvl, k // {ARITY}, size),
 subs as (select lang, lvl height, h subroot, row_number() over (order by encode(lang) nulls first) - 1 g, count(*) over () gs from nodes where size = 1),
 tops as (select 0 lvl, g k, subroot h, gs size from subs union all select lvl + 1, k // {ARITY}, sha256(string_agg(h, '' order by k)), (size + {ARITY - 1}) // {ARITY} from tops where size > 1 group by lvl, k // {ARITY}, size),
 families as (select lang, false top, lvl, k // {ARITY} up, list(h order by k) hs from nodes where size > 1 group by 1, 2, 3, 4 union all select null, true, lvl, k // {ARITY}, list(h order by k) from tops where size > 1 group by 1, 2, 3, 4),
 own as (select l.id, l.lang, false top, 0 lvl, l.pos k, coalesce(l.altered, l.leaf) h, '' proof, s.height, s.g, s.gs from leaves l join subs s on l.lang is not distinct from s.lang
  union all select o.id, o.lang, o.top or o.lvl = o.height, case when not o.top and o.lvl = o.height then 0 else o.lvl + 1 end, case when not o.top and o.lvl = o.height then o.g else o.k // {ARITY} end,
  case when not o.top and o.lvl = o.height then o.h else sha256(array_to_string(f.hs[1:o.k % {ARITY}], '') || o.h || array_to_string(f.hs[o.k % {ARITY} + 2:], '')) end,
  case when not o.top and o.lvl = o.height then o.proof else o.proof || array_to_string(f.hs[1:o.k % {ARITY}], '') || array_to_string(f.hs[o.k % {ARITY} + 2:], '') end, o.height, o.g, o.gs
  from own o left join families f on f.top = o.top and (o.top or f.lang is not distinct from o.lang) and f.lvl = o.lvl and f.up = o.k // {ARITY} where (not o.top and o.lvl = o.height) or f.hs is not null),
 ended as (select id, h, proof from own where top qualify lvl = max(lvl) over (partition by id))
 select l.doc_id, l.leaf, s.subroot, r.h root, sha256(e.proof) proof_sha256, e.h folded_root, e.h = r.h verified from leaves l join ended e using (id) join subs s on l.lang is not distinct from s.lang cross join (select h from tops where size = 1) r"""
