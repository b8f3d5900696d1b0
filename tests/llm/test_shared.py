"""Hashes, frequent keys and tables that the training-data operators share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import common, components, minhash, quality


def thue_morse(n):
    return bytes(97 + i.bit_count() % 2 for i in range(n))


def test_hash_beside_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    start = rng.integers(0, 2000, 60)
    end = start + rng.integers(0, 900, 60)
    prime = int(common.PRIME)

    def brute(part):
        return sum((x + 1) * pow(common.HASH.base, i, prime) for i, x in enumerate(part.tolist())) % prime

    expected = common.mix(np.array([brute(data[i:j]) for i, j in zip(start, end, strict=True)], np.uint64))
    assert (common.HASH.ranges(common.HASH.prefix(data), start, end) == expected).all()
    monkeypatch.setattr(common, "UNREDUCED", 64)
    assert (common.HASH.ranges(common.HASH.prefix(data), start, end) == expected).all()


def test_thue_morse_strings_differ(spark):
    one = thue_morse(4096)
    two = bytes(195 - c for c in one)
    data, offsets = np.frombuffer(one + two, np.uint8), np.array([0, 4096, 8192])
    _, shingle = minhash.shingle_sets(data, offsets, 2)
    assert len(set(shingle.tolist())) == 2
    lines = np.frombuffer(one + b"\n" + two, np.uint8)
    assert quality.base_counts(lines, np.array([0, len(lines)]))[3][0] == 0
    docs = spark.createDataFrame([(1, one.decode()), (2, two.decode())], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(docs, words=2).collect()} == {1, 2}


@pytest.fixture
def small_limits(monkeypatch):
    for module in (common, minhash):
        monkeypatch.setattr(module, "LEAST_FREQUENT", 2)
        monkeypatch.setattr(module, "FREQUENT", 20)


def test_frequent_keys_are_looked_up_alike(spark, small_limits):
    rows = spark.range(200).select("id", F.when(F.col("id") < 90, 0).otherwise(F.col("id") % 40).alias("key"))
    labels = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = common.looked_up(rows, "key", labels, "n", 200)
    assert sorted(map(tuple, found.select("id", "least").collect())) == sorted(map(tuple, rows.join(labels, "key").select("id", "least").collect()))


def test_components_with_a_frequent_node(spark, small_limits):
    links = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)], "a long, b long")
    found = {r.node: r.component for r in components.components(links, "a", "b").collect()}
    assert found == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(100, 131), 100)}


def test_near_duplicates_with_frequent_sets(spark, small_limits):
    body = [f"w{i % 53} v{i % 31}" for i in range(60)]
    texts = [" ".join(body)] * 40 + [" ".join([*body, f"x{i}"]) for i in range(40)] + [f"other text number {i} of several" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.component_id, r.chosen) for r in minhash.near_duplicates(docs, words=2).collect()}
    assert found == {i: (0 if i < 80 else i, i == 0 or i >= 80) for i in range(100)}


def test_tables_are_deleted(spark):
    from pathlib import Path

    one, two = (common.materialise(spark.range(3), "test-table") for _ in range(2))
    paths = [Path(t._written_to.removeprefix("file://")) for t in (one, two)]
    common.discard(one, spark.range(1))
    assert [p.exists() for p in paths] == [False, True] and two.count() == 3
