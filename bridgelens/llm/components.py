"""Connected components of a table of links, by alternating large and small stars.

Each round is a few aggregations and joins over the links; the result of a round is stored before
the next, so lineage stays short and a lost executor costs one round's step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgelens.llm.common import materialize


def are_stars(edges: DataFrame) -> bool:
    """Whether every link (u, v) leads straight to the smallest node of its component: each u has one
    link, and no v has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    counted = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not counted.agg(F.max((F.col("down") + F.col("up") > 1) & (F.col("down") > 0))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node it is connected with."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not are_stars(edges):
        # large star: the larger neighbours of a node link to its smallest neighbour
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest)
        edges = materialize(small.distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
