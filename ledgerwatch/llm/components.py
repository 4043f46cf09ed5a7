"""Connected components of an edge table, by alternating large and small stars.

Every round is one pass over the edges with joins on a node and its smallest neighbour; the number of rounds grows
with the logarithm of the nodes. Rounds are written to the shared folder, so plans stay short and a lost
executor costs no recomputation. Nothing but two totals per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import side


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node in ``edges`` (a bigint, b bigint): the smallest node that it reaches.

    Self-links and links to null are left out; repeated links and links in either direction count once."""
    up, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = cut_lineage(edges.where("a <> b").select(up, low).distinct())
    before, rows = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(side(_lowest(both), 2 * rows), "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        tied = large.join(side(_lowest(large), 2 * rows), "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(small.unionByName(tied.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, rows = state, state[0]
    root = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root)
