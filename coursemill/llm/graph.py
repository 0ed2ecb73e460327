"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges for each task that writes them; a small graph would else be as many tiny files as there are shuffle partitions.
TASK_EDGES, LEAST_TASKS = 250_000, 8


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> (node, component): the smallest node that can be reached. Nodes without an edge aren't returned.

    Each round is two joins on node keys, whose hubs adaptive execution splits, after
    minima that are pre-aggregated; rounds grow with the logarithm of the graph. Edges are
    written after each round, so Spark knows their size; their number never grows. Null
    ends, loops and repeated edges are dropped.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")
        # Every edge still goes from the larger node to the smaller one.
        small = large.join(least, "u").select(ends).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = written(small.coalesce(max(LEAST_TASKS, -(-before[0] // TASK_EDGES))), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
