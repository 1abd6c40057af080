"""Connected components of an edge table, by alternating large and small stars.

Each round links every node to the smallest node it knows (large star: its
larger neighbours; small star: its smaller ones), until the edges form stars.
Rounds are stored in the shared folder; only a count and a checksum of the
edges reach the driver.  The per-node minimum is a partially aggregated sum,
so a node with very many links costs one row per task; the join that hands
the minimum back has plain shuffles on both sides, which adaptive execution
splits when one node holds most of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expcurve.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"),
                    F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(low, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).union(moved).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is its component's smallest node.

    Edges are undirected; nulls and self-loops are ignored, repeated edges
    count once.  A node without edges is not returned.
    """
    edges = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _signature(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = _signature(edges)
        if now == before:
            break
        before = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(edges.select(F.col("v"), F.col("v"))).distinct())
