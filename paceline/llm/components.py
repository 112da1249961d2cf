"""Connected components of a link table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import compact


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has one smaller neighbour and no larger one, or no smaller one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.count("*").alias("n")).where("down > 1 OR (down = 1 AND n > 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, comp for every node of links (a, b): comp is its component's smallest node.

    Each round points every node's larger neighbours, then its smaller ones, at
    its smallest neighbour (two aggregations and two joins over the links); the
    links become stars in a logarithmic number of rounds.  Each round is written
    to the checkpoint folder.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    edges, _ = compact(links.where("a <> b").select(hi.alias("u"), lo.alias("v")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, _ = compact(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
