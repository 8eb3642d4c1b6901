"""Derived data: validation, badges, run changes, sweeps and state changes, as set-based plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def badges(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def all_registered(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Per version whether each of its metrics is registered; a version without results is vacuously so elsewhere."""
    known = registry.where(F.col("kind") == "metrics").select(F.col("id").alias("metric"), F.lit(True).alias("known"))
    cited = results.select("version_id", "metric").distinct().join(known, "metric", "left")
    return cited.groupBy("version_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("registered"))


def citing(results: DataFrame, metric: str) -> DataFrame:
    return results.where(F.col("metric") == metric).select("version_id").distinct()


def run_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """What writing a batch does to each run: created, updated, unchanged, or refused for a tombstoned one."""
    had = old.select("record_id", "run_id", F.col("content_hash").alias("old_hash"), F.col("tombstoned").alias("gone"))
    rows = new.select("record_id", "run_id", "content_hash").join(had, ["record_id", "run_id"], "left")
    change = F.when(F.col("gone"), "refused").when(F.col("old_hash").isNull(), "created").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("updated")
    return rows.select("record_id", "run_id", change.alias("change"))


def repeated_in_batch(batch: DataFrame, order: str) -> DataFrame:
    """The second and later occurrences of a run id within a batch."""
    place = Window.partitionBy("record_id", "run_id").orderBy(order)
    return batch.withColumn("occurrence", F.row_number().over(place)).where("occurrence > 1")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not new, and the new rows."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the largest order."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def unreferenced(objects: DataFrame, created: str, before: Column, *refs: DataFrame) -> DataFrame:
    """Objects (sha256) older than the cutoff that no table of references names."""
    found = objects.where(F.col(created) < before)
    for r in refs:
        found = found.join(r.select("sha256"), "sha256", "left_anti")
    return found


def extend_used(old: DataFrame, more: DataFrame) -> DataFrame:
    """The used set only grows: rows that are there keep their hash."""
    return old.unionByName(more.join(old.select("record_id", "run_id"), ["record_id", "run_id"], "left_anti"))


def changed_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per id the sorted keys whose value differs between two exploded objects (id, key, value)."""
    both = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["id", "key"], "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("changed"))
