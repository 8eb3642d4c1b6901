"""An append-only log whose ids grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staged import shared_folder


def numbered(rows: DataFrame, order: list[str], last: int = 0) -> DataFrame:
    """Rows with ``audit_id`` from last + 1 in the order given.

    Range partitions are sorted, number their own rows and are written once, so that both sides of the join below see the same
    ranges; a small table of partition sizes gives each its start.
    """
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    own = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33)).withColumn("_n", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = own.groupBy("_part").agg(F.count("*").alias("_rows"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(starts.select("_part", "_before"), "_part").select(*rows.columns, (F.col("_before") + F.col("_n") + 1 + last).cast("long").alias("audit_id"))
