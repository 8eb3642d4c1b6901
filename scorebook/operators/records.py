"""Records and their versions: liveness, latest, visibility, lookups, and the record search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filters, paging


def live(versions: DataFrame) -> DataFrame:
    return versions.where(~F.col("tombstoned"))


def latest(versions: DataFrame) -> DataFrame:
    """The latest live version of each record: one row a record leaves each task before the shuffle."""
    rest = [c for c in versions.columns if c not in ("record_id", "seq")]
    best = live(versions).groupBy("record_id").agg(F.max_by(F.struct("seq", *rest), "seq").alias("v"))
    return best.select("record_id", "v.*").select(*versions.columns)


def visible(caller: list[str]) -> Column:
    """Public, or in a namespace of the caller's."""
    return (F.col("visibility") == "public") | F.col("ns").isin(caller) if caller else F.col("visibility") == "public"


def scan(records: DataFrame, versions: DataFrame, caller: list[str], every: bool = False) -> DataFrame:
    """Live visible versions with their record's columns: the latest ones, or all."""
    return (live(versions) if every else latest(versions)).join(records.where(visible(caller)), "record_id")


def best_metric(results: DataFrame, metric: str, direction: str) -> DataFrame:
    """version_id and the best value of the metric in the sort's own direction."""
    best = F.max("value") if direction == "desc" else F.min("value")
    return results.where(F.col("metric") == metric).groupBy("version_id").agg(best.alias("best"))


def check_metric(registry: DataFrame, metric: str) -> None:
    """A metric sort needs the metric registered, in any version."""
    if registry.where((F.col("kind") == "metrics") & (F.col("id") == metric)).isEmpty():
        raise filters.FilterError("/sort", "not_indexed")


def search(records: DataFrame, versions: DataFrame, words: filters.Vocabulary, where: dict | None = None, sort: list[tuple[str, str]] = (), caller: list[str] = (), limit: int = paging.USUAL, cursor: list | None = None, every: bool = False, metric: tuple[DataFrame, str] | None = None) -> DataFrame:
    """One plan: scan, filter, metric join, keyset, order, limit + 1. A metric sorts under the name ``best``."""
    found = filters.apply(scan(records, versions, list(caller), every), where, words)
    keys = paging.with_tie(list(sort), "version_id", [("created_at", "desc")])
    if metric:
        direction = next((d for c, d in sort if c == "best"), "desc")
        found = found.join(best_metric(*metric, direction), "version_id", "left")
    return paging.page(found, keys, limit, cursor, drop_nulls=True)


def by_seq(versions: DataFrame, seq: int) -> DataFrame:
    return versions.where(F.col("seq") == seq)


def next_seq(versions: DataFrame) -> DataFrame:
    """The number that the next version of each record takes; tombstoned versions count."""
    return versions.groupBy("record_id").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def namespace_counts(records: DataFrame, versions: DataFrame, caller: list[str]) -> DataFrame:
    """Visible records with a live version, per namespace."""
    return records.where(visible(caller)).join(live(versions).select("record_id"), "record_id", "left_semi").groupBy("ns").agg(F.count("*").alias("records"))


def changed(versions: DataFrame, columns: list[str]) -> DataFrame:
    """Per live version the sorted names of the columns that differ from the live version before; all for the first."""
    before = Window.partitionBy("record_id").orderBy("seq")
    first = F.lag("version_id").over(before).isNull()
    differs = [F.when(first | ~F.col(c).eqNullSafe(F.lag(c).over(before)), F.lit(c)) for c in sorted(columns)]
    return live(versions).select("version_id", "record_id", "seq", F.array_compact(F.array(*differs)).alias("changed"))
