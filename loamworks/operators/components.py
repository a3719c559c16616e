"""Connected components of a table of edges, by rounds of joins: every node hangs on the least node it knows of until nothing moves.

A round is a minimum per node and an equi-join on it; neighbours are never listed, and the driver sees a count and a checksum only.
Rounds are written tables, so their number does not lengthen the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def _hung(edges: DataFrame) -> DataFrame:
    """Edges (high, low): first all greater neighbours of a node hang on its least one, then all lesser ones do."""
    ways = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = ways.groupBy("high").agg(F.least("high", F.min("low")).alias("least"))
    greater = ways.join(least, "high").filter("low > high").select(F.col("low").alias("high"), F.col("least").alias("low"))
    greater = written(greater.filter("high != low").distinct())
    least = greater.groupBy("high").agg(F.min("low").alias("least"))
    lesser = greater.join(least, "high").filter("low != least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return written(lesser.unionByName(least.select("high", F.col("least").alias("low"))).filter("high != low").distinct())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Every node that has an edge to another one: node and component, the least node of its component."""
    now = edges.select(F.greatest(u, v).alias("high"), F.least(u, v).alias("low")).filter("high != low").distinct()
    now, before = written(now), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("high", "low")).alias("x")).first()
        if state == before or state["n"] == 0:
            break
        now, before = _hung(now), state
    members = now.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return members.unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
