"""Typed relations as an edge table (from_id, type, to_id): neighbours, bounded traversal, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staged import shared_folder


def outgoing(edges: DataFrame, nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges out of the nodes (node), in order of type and target."""
    found = edges.join(nodes, F.col("from_id") == F.col("node"), "left_semi")
    return (found.where(F.col("type").isin(types)) if types else found).select("from_id", "type", "to_id")


def incoming(edges: DataFrame, nodes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Edges into the nodes by id, or by textual target (node, text): two equi-joins, not one join on either."""
    found = edges.join(nodes, F.col("to_id") == F.col("node"), "left_semi").select("from_id", "type", "to_id")
    if texts is not None:
        by_text = edges.join(texts, F.col("to_id") == F.col("text")).select("from_id", "type", F.col("node").alias("to_id"))
        found = found.unionByName(by_text)
    return found.distinct()


def traverse(edges: DataFrame, start: DataFrame, depth: int = 1, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """node and its least distance from the start (node), breadth first; depth is held to 1..5.

    The hops and each frontier are written to the shared folder, so a hop is one join and an anti join over what was met before
    and nothing is worked out twice; a small frontier is known as small by its files, so that the hops are not shuffled for it.
    Edges may repeat. Nothing is collected but whether a frontier is empty.
    """
    spark, root = edges.sparkSession, shared_folder(edges.sparkSession)
    if types:
        edges = edges.where(F.col("type").isin(types))
    hops = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("next"))
    back = edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("next"))
    hops = {"out": hops, "in": back, "both": hops.unionByName(back)}[direction]
    hops.write.parquet(f"{root}/hops")
    hops = spark.read.schema(hops.schema).parquet(f"{root}/hops")
    frontier = start.select("node").distinct().withColumn("distance", F.lit(0))
    for step in range(max(1, min(5, depth)) + 1):
        frontier.write.parquet(f"{root}/met/step={step}")
        form = "node " + start.schema["node"].dataType.simpleString() + ", distance int"
        met = spark.read.schema(form).parquet(*[f"{root}/met/step={k}" for k in range(step + 1)])
        now = spark.read.schema(form).parquet(f"{root}/met/step={step}")
        if now.isEmpty():
            break
        frontier = now.join(hops, "node").select(F.col("next").alias("node")).distinct().join(met, "node", "left_anti").withColumn("distance", F.lit(step + 1))
    return met


def hidden(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes as a reader sees them: those not in ``seen`` (node, label) show their id alone."""
    return nodes.join(seen.withColumn("_seen", F.lit(True)), "node", "left").select("node", F.col("_seen").isNull().alias("private"), "label")
