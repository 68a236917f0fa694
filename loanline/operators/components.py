"""Connected components by star contraction, for graphs that fit no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanline.sources.folders import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("at"), F.least("a", "least").alias("least"))
    return (
        both.filter("b > a")
        .join(least, F.col("a") == F.col("at"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Expects ``b < a``."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least.withColumnRenamed("a", "at"), F.col("a") == F.col("at"))
    return (
        moved.filter("b <> least")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionByName(least.select("a", F.col("least").alias("b")))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it reaches.

    ``edges`` has two columns of one ordered type; direction, order, repeats, loops and nulls in it do not matter
    (a loop or a null links nothing). Large-star and small-star rounds contract the graph until each component is one
    star; their number grows with the logarithm of the longest path. Only two totals per round reach the driver.
    """
    first, second = edges.columns
    links = (
        edges.filter(F.col(first) != F.col(second))
        .select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
        .distinct()
    )
    links, before = stored(links, "links"), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        links = stored(_small_star(_large_star(links)), "links")
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
