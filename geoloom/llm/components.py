"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.staging import drop, materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``, root being the component's smallest node.

    Each round rewires nodes to the smallest neighbour they know, until all components are
    stars; the number of rounds grows with the logarithm of the longest path.  A component's root is a hub with
    as many edges as the component has nodes.  They are only pre-aggregated and joined, and
    the smallest neighbours are tables of their own: both sides of the joins then have an exchange,
    and Spark can split a hub between tasks.  Every round is written to the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "lows")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = materialize(large, "edges")
        drop(low)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("low")), "lows")
        small = large.join(low, "a").select("a", "b", "low")
        small = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        small = materialize(small, "edges")
        drop(now, large, low)
        now = small
        if _stars(now):
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct ``edges(a, b)``, a > b, either points to one other or is pointed to."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where(F.col("out") + F.col("into") > 1).isEmpty()
