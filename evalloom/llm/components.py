"""Connected components by alternating large-star and small-star steps; nothing of a graph goes to the driver but a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import discard, looked_up, materialise


def _star(neighbours: DataFrame, total: int, larger: bool) -> DataFrame:
    """(u, v) neighbours to links (v, m), m the least of u and its neighbours; of all v > u, or of all v <= u and u itself."""
    least = neighbours.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    both = looked_up(neighbours, "u", least, "n", total)
    if larger:
        return both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for every node with a link, in a table; a component's name is its least node.

    Each step is written to the shared folder, and the one before it deleted. The number of rounds is
    logarithmic in the number of nodes; the end is reached when a round leaves the links as they were.
    Self-links and nulls don't count. A node with a large share of all links isn't joined in one task.
    """
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "links")
    seen = None
    while True:
        checksum = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1000003).cast("long"))).first()
        if checksum == seen or not checksum[0]:
            named = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            out = materialise(named, "components")
            discard(edges)
            return out
        seen = checksum
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_star(around, 2 * checksum[0], larger=True).distinct(), "links")
        small = materialise(_star(large, 2 * checksum[0], larger=False).distinct(), "links")
        discard(edges, large)
        edges = small
