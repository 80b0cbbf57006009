"""Connected components of an edge table by alternating star contraction.

Each round joins every node with the smallest of its neighbours, first over
larger, then over smaller neighbours, until the edges form one star per
component.  The edges stay distributed: per-node minima are partial
aggregates, and the join on the node is split by adaptive execution when one
node holds many edges.  Rounds grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _larger_to_least(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges ``(a, b)`` of longs to rows ``(node, component)``, the component being its smallest node.

    Nodes without an edge to another node are not returned.  Self loops,
    repeated edges and either direction are allowed; null ends are ignored.
    """
    state = written(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "component-edges",
    )
    before = None
    while True:
        now = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before or not now["n"]:
            break
        before = now
        state = written(_smaller_to_least(_larger_to_least(state)).distinct(), "component-edges")
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
