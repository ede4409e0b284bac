"""Connected components of an edge table, in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Label each node of ``edges(u, v)`` with its component's least node: (node, label).

    Alternating star steps: every node points its larger neighbours, then its smaller ones and
    itself, to the least node it knows, until nothing changes; the rounds grow with the logarithm
    of the longest path. Least nodes are aggregated before the shuffle, and the joins split hot
    nodes when adaptive execution is on. Loops and repeated edges are allowed; rows with a null
    end are left out. No edges give no rows.
    """
    pairs = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        # done when each node points to one other and none points to a node that itself points
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("centre")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("centre")))
        known = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("centre").alias("centre"))
        if not known.where("points + centre > 1").limit(1).count():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")
