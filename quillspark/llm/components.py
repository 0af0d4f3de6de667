"""Connected components by alternating large and small stars.

Each round hangs the larger neighbours of a node on its smallest one, then the
same for the smaller neighbours.  Groups are never collected: a round is
aggregations (combined on the map side) and equi-joins on the edge list, written
to the shared folder, so that lineage stays short and a lost executor costs one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge (a, b)."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))
        ).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        e = materialize(small.where("a <> b").distinct(), "edges")
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.count_distinct("a")).first()
        if row[0] == row[2] and tuple(row) == before:
            break
        before = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
