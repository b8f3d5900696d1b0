"""Whitening and exact top-k beside brute force, and their defined cases."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import inner_products, vectors, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, whitened string, deviation string, label string, row_no string, id string, length string, x string, group string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, *["z"] * 8) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Vectors of three entries beside null, partly null, infinite, too long, too short and too large ones; repeats and null ids."""
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [math.nan, 0.0, 0.0]), (53, [math.inf, 0.0, 0.0]), (54, [1.0, 2.0]), (55, []), (56, [1e300, 0.0, 0.0])]
    return table(spark, [*good, good[7], (None, [0.5, 0.5, 0.5]), *bad]), [*good, good[7], (None, [0.5, 0.5, 0.5])]


def test_whitened_beside_brute_force(odd):
    df, good = odd
    x = np.floor(64 * np.array([v for _, v in good])).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    model = whitening.fit(df)
    assert (model.n, model.sums) == (n, sums.tolist()) and model.identity_error < 1e-12
    d = x - sums / n
    values, axes = np.linalg.eigh(d.T @ d / n)
    assert np.allclose(model.eigenvalues, values[::-1]) and np.allclose(model.explained, values[::-1] / values.sum())
    out = whitening.whiten(df, model).collect()
    expected = {tuple(v): ((d[i] @ axes)[::-1] / np.sqrt(values[::-1]), int(((n * x[i] - sums) ** 2).sum())) for i, (_, v) in enumerate(good)}
    assert sorted(str(r.vec_id) for r in out) == sorted(str(i) for i, _ in good) and all(r.label == r.x == "z" for r in out)
    for r in out:
        w, deviation = expected[tuple(r.embedding)]
        assert np.allclose(np.abs(r.whitened), np.abs(w)) and r.deviation == deviation


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None), (2, [math.nan])]):
        model = whitening.fit(table(spark, rows))
        assert model.n == 0 and whitening.whiten(table(spark, rows), model).count() == 0
    same = table(spark, [(i, [1.0, 2.0]) for i in range(5)])
    model = whitening.fit(same)
    assert model.n == 5 and len(model.eigenvalues) == 0 and [(r.whitened, r.deviation) for r in whitening.whiten(same, model).collect()] == [([], 0)] * 5
    flat = whitening.fit(table(spark, [(i, [float(i), 2.0 * i]) for i in range(9)]))
    assert len(flat.eigenvalues) == 1 and abs(flat.explained[0] - 1) < 1e-12


def test_deviations_are_exact():
    t, left = np.array([[3 << 40, -5], [1, 2]], np.int64), np.array([7, 1], np.int64)
    assert whitening.deviations(t, left, 2) == [None, (2 - 7) ** 2 + (4 - 1) ** 2]
    assert whitening.deviations(t[1:], left, 10) == [(10 - 7) ** 2 + (20 - 1) ** 2]


def test_usual_length_and_trees(spark):
    rows = table(spark, [(1, [1.0]), (2, [1.0, 2.0]), (3, [1.0]), (4, [2.0, 3.0]), (5, None)])
    assert vectors.usual_length(rows, "embedding") == 2 and vectors.usual_length(rows.limit(0), "embedding") == 0
    assert vectors.tree_sum(spark.range(100, numPartitions=40), lambda r: r.id, lambda a, b: a + b) == 4950
    assert [vectors.tree_depth(n) for n in (1, 1000, 40_000, 10**6)] == [2, 2, 4, 4]


def brute(rows, k, asks):
    """Rows as (id, vector or None)."""
    x = [(n, i, [math.floor(256 * c) for c in v]) for n, (i, v) in enumerate(rows)]
    out = []
    for n, i, q in x:
        if i is not None and asks(i):
            cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            scores = sorted((-cut(sum(map(int.__mul__, q, p))), j is None, j or 0) for m, j, p in x if m != n)
            out += [(i, rank, None if no else j, -s) for rank, (s, no, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def found(df, k, asks):
    return sorted(((r.query_id, r.rank, r.id, r.score) for r in inner_products.top_k(df, asks, k).collect()), key=str)


def test_top_k_beside_brute_force(odd):
    df, good = odd
    assert found(df, 4, F.col("vec_id") % 5 == 0) == brute(good, 4, lambda i: i % 5 == 0)
    assert found(df.limit(0), 4, F.lit(True)) == []


def test_top_k_with_groups_ties_and_long_vectors(spark, monkeypatch):
    for name, value in {"LEAST_GROUP": 64, "TILE": 16, "BLOCK": 4, "DENSE": 0.3}.items():
        monkeypatch.setattr(inner_products, name, value)
    rng = np.random.default_rng(5)
    vs = (rng.normal(size=(300, 6)) * rng.pareto(1.5, size=(300, 1)) * [5, 3, 1, 1, 0.2, 0.1]).round(2).tolist()
    rows = [(i, vs[0] if i % 3 == 0 else v) for i, v in enumerate(vs)]
    assert found(table(spark, rows), 5, F.col("vec_id") % 7 == 0) == brute(rows, 5, lambda i: i % 7 == 0)
    huge = [*rows[:20], (20, [2e9, 0.0, 1.0, 0, 0, 0]), (21, [1e12, 1e12, 0.0, 0, 0, 0]), (22, [-1e15, 0.0, 0.0, 0, 0, 0])]
    huge = [(i, [float(c) for c in v]) for i, v in huge]
    assert found(table(spark, huge), 3, F.col("vec_id") >= 18) == brute(huge, 3, lambda i: i >= 18)
    few = rows[1:3]
    assert found(table(spark, few), 5, F.lit(True)) == brute(few, 5, lambda i: True)


def test_queries_beside_sql_and_lapack(spark):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = sorted(map(tuple, inner_products.query(spark, DATA).collect()))
    assert got == sorted(con.sql(inner_products.SQL).fetchall()) and len(got) == 50
    out = whitening.query(spark, DATA).toPandas()
    assert len(out) == 500 * 32 and out.component.between(1, 32).all() and (out.n == 500).all() and out.identity_error.max() < 1e-9
    rows = con.sql("select vec_id, embedding from embeddings order by 1").fetchall()
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 1_000_000
    assert dict(zip(out.vec_id, out.deviation, strict=True)) == {i: int(s) for (i, _), s in zip(rows, ((500 * x - x.sum(axis=0)) ** 2).sum(axis=1), strict=True)}
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / 500 - np.eye(32)).max() < 1e-9
