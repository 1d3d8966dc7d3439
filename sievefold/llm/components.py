"""Connected components of links, as joins and aggregates: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(links: DataFrame) -> bool:
    """Whether every node is either a centre or linked to one centre."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    each = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return each.where("leaf > 1 or (leaf = 1 and centre = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root of every node in links (u, v); the root is the component's smallest node.

    A star's centre may be linked to any share of the nodes: its minimum is pre-aggregated in each
    task and stored, so that Spark may split the join that hands it out. Every round is a table in the
    shared folder.
    """
    now = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        small = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        now = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(now.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
