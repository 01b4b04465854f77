"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node and one join, so no group is ever gathered in a task. The minima are
written before they are joined: the join then reads plain tables on both sides, so that Spark
broadcasts a small one and adaptive execution can split a node that has very many edges. The number
of rounds grows with the logarithm of the longest chain. Each round is written to the shared folder,
which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import forget, saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of an edge; a component is its smallest node.

    Nulls, loops and repeated edges are ignored; no edges, or only such ones, give no rows.
    """
    low, high = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    now = saved(edges.where(F.col(a) != F.col(b)).select(high, low).distinct(), "edges")
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        smaller = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(smaller, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = saved(small.unionByName(smaller.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(now, least, large, smaller)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Does every larger node have one edge, to a node that is nowhere the larger one?"""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
