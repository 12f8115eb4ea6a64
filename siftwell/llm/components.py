"""Connected components of a link table, by alternating large and small stars.

Every step is a minimum per node and a join, so no neighbourhood is ever gathered in one
place; each round is written, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Stages


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with b < a."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _flat(links: DataFrame) -> bool:
    """Whether each node points to one root, and no root points on."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("o"), F.max("i").alias("i")).where("o + i > 1").isEmpty()


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """(node, root): root is the least node that can be reached. links: (a, b), any order;
    nodes without links are left out."""
    links = stages.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _flat(links):
        old, links = links, stages.write(_star(_star(links, True), False))
        stages.drop(old)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
