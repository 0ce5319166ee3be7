"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.sources.shared import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """v and root, the least vertex connected to v, for every vertex of ``edges`` (a, b).

    Labels sink along edges and by pointer jumping; every round is written to
    the shared folder, so a lost executor costs one round at most.
    """
    ways = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(ways.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    for _ in range(rounds):
        around = ways.join(labels.withColumnsRenamed({"v": "b", "root": "near"}), "b").groupBy(F.col("a").alias("v")).agg(F.min("near").alias("near"))
        sunk = labels.join(around, "v", "left").select("v", "root", F.least("root", "near").alias("next"))
        jumped = sunk.join(labels.withColumnsRenamed({"v": "next", "root": "beyond"}), "next", "left")
        labels = written(jumped.select("v", F.least("next", "beyond").alias("root"), (F.least("next", "beyond") < F.col("root")).alias("_moved")))
        still = labels.where("_moved").limit(1).count() == 0
        labels = labels.select("v", "root")
        if still:
            return labels
    raise RuntimeError("components did not settle")
