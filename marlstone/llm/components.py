"""Connected components of an edge table, by alternating star contraction.

Every round is a join and two aggregations over the edges; the table of each round is written to the shared folder, so
lineage stays short and nothing but a row count reaches the driver. Aggregations combine before their shuffle, so a hub
costs no more than its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands its greater neighbours to its least neighbour."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node hands itself and its lesser neighbours to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another one; root is the least node that it reaches.

    Edges from a node to itself and repeated edges are allowed; a null end drops the edge.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    while True:
        e = cut(_small_star(_large_star(e)))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
