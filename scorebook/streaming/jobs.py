"""Incremental jobs that take what is new and stop: ingest of bodies, and the badge sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derive
from ..sources import ingest


def ingest_bodies(spark: SparkSession, source: str, root: str, checkpoint: str) -> None:
    """New JSON lines (version_id, body) become rows of the side tables under root.

    A batch that is repeated after a failure overwrites its own partition, so no row is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        for name, rows in ingest.side_tables(batch).items():
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")

    lines = spark.readStream.schema("version_id long, body string").json(source)
    lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def badge_sweep(spark: SparkSession, results: str, registry: DataFrame, out: str, checkpoint: str) -> None:
    """The registered badge of versions whose results arrived since the last sweep."""
    schema = spark.read.parquet(results).schema

    def write(batch: DataFrame, number: int) -> None:
        found = derive.all_registered(batch.select("version_id", "metric"), registry)
        found.withColumn("swept", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(results)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
