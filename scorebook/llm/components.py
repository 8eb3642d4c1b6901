"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Edges of one task; few edges shall not be spread over very many tasks in each round.
TASK_EDGES = 100_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(pairs: DataFrame, keep: str, tasks: int) -> DataFrame:
    """Link the chosen neighbours of each node to its smallest one, itself included.

    The minima are written first: then both join sides are plain shuffles, and a node with very many
    neighbours is split over tasks.
    """
    least = materialise(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).coalesce(tasks), "cc-least")
    linked = pairs.join(least, "u").coalesce(tasks).where(keep).select(F.col("m").alias("a"), F.col("v").alias("b"))
    if keep == "v < u":
        linked = linked.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    out = materialise(linked.where("a <> b").distinct().coalesce(tasks), "cc-edges")
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for each node of the edges (a, b); long ids.

    Each round is a fixed number of shuffles of the edges; rounds grow with the log of the longest path.
    """
    now = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    tasks = 4 + now.count() // TASK_EDGES
    seen = None
    while True:
        large = _star(_both(now), "v > u", tasks)
        small = _star(large.select(F.col("b").alias("u"), F.col("a").alias("v")), "v < u", tasks)
        mark = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        discard(now, large)
        now = small
        if mark == seen:
            break
        seen = mark
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.union(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
