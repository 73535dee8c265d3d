"""Connected components by alternating large-star and small-star rounds; each round is checkpointed.

A hub's edges are dealt to many tasks: the least neighbour of each node is found with partial aggregation and meets the
edges in a join that splits hot nodes.

Defined results: a loop or a repeated edge changes nothing; an edge with a null end is none; no edges give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import settle, spread_join

#: Edges that one task takes; few edges aren't dealt to more tasks than they need.
EDGES_PER_TASK = 100_000


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the least neighbour ``m`` of their end ``a``; ``least`` has a, m and n, the edges of a."""
    least = settle(least)
    return spread_join(edges, least.select("a", "m"), "a", ["b"], "inner", least.select("a", "n"))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")).coalesce(tasks)
    return _met(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").coalesce(tasks).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """A node and its neighbours below are tied to the least of them; edges run from large (a) to small (b)."""
    least = settle(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).coalesce(tasks))
    tied = _met(edges, least).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node that is tied to another is so once, and nothing is tied to it."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, in any order) to (a, b): each node but the least of its component, and that least."""
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    tasks = math.ceil(edges.count() / EDGES_PER_TASK)
    while tasks and not _are_stars(edges.coalesce(tasks)):
        large = settle(_large_star(edges.coalesce(tasks), tasks))
        edges = settle(_small_star(large, tasks).coalesce(tasks))
        tasks = math.ceil(edges.count() / EDGES_PER_TASK)
    return edges
