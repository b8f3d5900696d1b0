"""The dataset's Merkle tree beside a tree made by hand."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from evalloom.llm import manifest

DATA = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root, and for each node the siblings before and after it, level by level."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(places):
            run, own = nodes[k // 8 * 8 : k // 8 * 8 + 8], k % 8
            proofs[i].append((run[:own], run[own + 1 :]))
            places[i] = k // 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def by_hand(rows):
    """(key, group, value) rows to a sorted list of what a manifest says."""
    if not rows:
        return []
    low = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    leaf = lambda r: h("-" if r[2] is None else f"{len(r[2].encode())}:{r[2]}")
    groups = sorted({r[1] for r in rows}, key=low)
    members = [sorted((r for r in rows if r[1] == g), key=lambda r: (low(r[0]), leaf(r))) for g in groups]
    subs = [tree([leaf(r) for r in m]) for m in members]
    root, above = tree([s for s, _ in subs])
    return sorted((str((r[0], r[1], leaf(r), s, root, p + a)) for m, (s, ps), a in zip(members, subs, above, strict=True) for r, p in zip(m, ps, strict=True)))


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, lang string, text string, leaf string, g string")
    out = manifest.manifest(df, "doc_id", "lang", manifest.leaf_hash(F.col("text")), again=F.col("leaf"))
    got = out.withColumn("top", manifest.folded(F.col("leaf"), F.col("siblings"))).collect()
    assert all(r.top == r.root and r.again == "x" for r in got)
    return sorted(str((r.doc_id, r.lang, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.siblings])) for r in got)


@pytest.fixture(params=[None, 3, 20])
def parts(request, monkeypatch):
    """Leaves in one part, and in many."""
    if request.param:
        monkeypatch.setattr(manifest, "PART", request.param)
        monkeypatch.setattr(manifest, "REGIONS", 2)


TABLES = {
    "nothing": [],
    "one row": [(1, "a", "text")],
    "one group": [(i, "a", f"text {i}") for i in range(70)],
    "every row its own": [(i, f"g{i:03}", f"text {i}") for i in range(70)],
    "nulls, repeats and a group with most rows": [(i if i % 10 else None, "a" if i % 5 else ("é", "b", None)[i % 3], None if i % 7 == 0 else f"text {i % 40}") for i in range(130)] + [(5, "a", "text 5")] * 11,
}


@pytest.mark.parametrize("name", TABLES)
def test_manifest_beside_hand_made(spark, parts, name):
    assert found(spark, TABLES[name]) == by_hand(TABLES[name])


def test_levels():
    assert [manifest.on_level(65, k) for k in range(4)] == [65, 9, 2, 1] and [manifest.height(n) for n in (1, 2, 8, 9, 65)] == [0, 1, 1, 2, 3]


def test_events_in_any_order():
    leaves = [h(str(i)) for i in range(20)]
    climb = manifest.Climb()
    for i in (19, 3, *range(4, 19), 2, 1):
        climb.arrive(0, 0, i, leaves[i], 20, 1)
    assert set(climb.partial) == {(0, 1, 0), (0, 2, 0)} and set(climb.whole) == {(0, 1, 1), (0, 1, 2)}
    assert list(climb.above((0, 1, 0))) == [(0, 1, 0), (0, 2, 0)]
    climb.join((0, 1, 0), {0: leaves[0]}, 20, 1)
    assert not climb.partial and h(*climb.whole[0, 2, 0]) == tree(leaves)[0]


def test_query_beside_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = manifest.query(spark, DATA).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(manifest.SQL).fetchall()))
    assert 0 < sum(not r.verified for r in got) < len(got)
