"""Connected components of an undirected graph held as a table of edges, by alternating large-star and small-star rounds.

Every round is a minimum per node and a join on it: a node's neighbours are never held as one list. The edges of a node with very
many stand under one key of the join, which Spark's adaptive skew join splits over tasks. Rounds end in a written table, and the
driver sees only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _star(edges: DataFrame) -> DataFrame:
    """Large star, then small star; edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    large = stash(large)
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(least, "u")
    moved = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stash(moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """Per node with an edge: the node and the least node of its component. ``edges`` has columns u and v of one orderable type."""
    now = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    seen = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (sums["n"], sums["x"]) == seen or not sums["n"]:
            break
        seen = (sums["n"], sums["x"])
        now = _star(now)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
