"""Connected components from links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.sizing import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star; ``edges`` holds (u, v) with u > v, each once.

    Every step is an aggregate with map-side combining and a join, so a node with very many links is
    never gathered in one place.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    large = (both.join(least, "u").where("v > u and v <> w")
             .select(F.col("v").alias("u"), F.col("w").alias("v")).distinct())
    least = large.groupBy("u").agg(F.min("v").alias("w"))
    small = large.join(least, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return small.unionByName(least.select("u", F.col("w").alias("v"))).distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    Null ends and links of a node with itself are ignored, repeated links count once.  The rounds grow with
    the logarithm of the longest path; each is written to the checkpoint folder, so a lost executor
    costs one round at most.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = cut_lineage(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before, now = None, _signature(edges)
    while now != before and now[0]:
        edges = cut_lineage(_stars(edges))
        before, now = now, _signature(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
