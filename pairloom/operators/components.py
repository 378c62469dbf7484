"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import materialise, release


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_iter: int = 60) -> DataFrame:
    """(node, component): the smallest node of each node's component.  Nodes without an edge to another node don't appear.

    Each round takes the smallest label among the neighbours and then the label's own label (pointer jumping), so rounds grow with the logarithm
    of a path's length, not with the length.  Rounds are written to the shared folder, which cuts the lineage.
    """
    one = edges.where(F.col(u) != F.col(v)).select(F.col(u).alias("a"), F.col(v).alias("b"))
    both = materialise(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(max_iter):
        own = labels.select("node", "component")
        heard = both.join(own.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        near = own.join(heard.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        jump = near.select(F.col("node").alias("c"), F.col("c").alias("further"))
        after = materialise(near.join(jump, "c", "left").select("node", F.least("c", F.coalesce("further", "c")).alias("component"), "old"))
        release(labels)
        labels = after
        if after.where(F.col("old") != F.col("component")).isEmpty():
            release(both)
            done = labels.select("node", "component")
            done._materialised_at = labels._materialised_at
            return done
    raise RuntimeError(f"components didn't settle in {max_iter} rounds")
