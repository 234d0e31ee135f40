"""Connected components of an edge table by alternating stars.

Each round links every node's larger neighbours to its smallest one, then every
node and its smaller neighbours to the smallest of them; rounds grow with the
logarithm of the longest chain. All steps are joins and grouped minima; the
neighbours of a node are never gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardbook.session import cut_lineage


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) have u > v."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another."""
    x, y = F.col(a), F.col(b)
    now = cut_lineage(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    seen = _print(now)
    while seen[0]:
        now = cut_lineage(_star(_star(now, large=True), large=False))
        new = _print(now)
        if new == seen:
            break
        seen = new
    # every edge now points at its component's smallest node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
