"""Level-by-level reach over a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut


def reach(edges: DataFrame, seeds: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth) of every node within `depth` links of the seeds, at its least depth; each level is written once."""
    level = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0).cast("long"))
    seen = level = cut(level)
    for d in range(1, depth + 1):
        new = edges.join(level.select(F.col("node").alias(src)), src).select(F.col(dst).alias("node")).distinct()
        level = cut(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(d).cast("long")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
