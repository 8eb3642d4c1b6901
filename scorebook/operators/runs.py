"""The runs of a set, masked for the reader and joined with judgements; used sets and their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from . import filters, paging

MASKED = ["status", "error_kind", "content_hash", "lang"]


def state(member: bool) -> Column:
    """live, archived or deleted as the reader sees it; for others an archived run is deleted."""
    return F.when(F.col("tombstoned"), "deleted").when(F.col("archived"), "archived" if member else "deleted").otherwise("live")


def admitted(runs: DataFrame, used: DataFrame | None, member: bool, include: set[str] = frozenset()) -> DataFrame:
    """Live runs; with ``include`` a member's archived or deleted ones; and any that a named card used."""
    gone = F.col("tombstoned")
    ok = ~gone & ~F.col("archived")
    if member and "archived" in include:
        ok = ok | (F.col("archived") & ~gone)
    if member and "deleted" in include:
        ok = ok | gone
    if used is None:
        return runs.where(ok).withColumn("used", F.lit(False))
    keys = used.select("record_id", "run_id").distinct().withColumn("used", F.lit(True))
    return runs.join(keys, ["record_id", "run_id"], "left").withColumn("used", F.coalesce("used", F.lit(False))).where(ok | F.col("used"))


def masked(rows: DataFrame, member: bool) -> DataFrame:
    """Columns of runs that the reader may not see are null, before any filter or sort."""
    seen = ~F.col("tombstoned") & (F.lit(member) | ~F.col("archived"))
    return rows.withColumns({"state": state(member)} | {c: F.when(seen, F.col(c)) for c in MASKED if c in rows.columns})


def with_metric(rows: DataFrame, metrics: DataFrame, metric: str, name: str) -> DataFrame:
    """One metric as a column; runs without it have null."""
    one = metrics.where(F.col("metric") == metric).select("record_id", "run_id", F.col("value").alias(name))
    return rows.join(one, ["record_id", "run_id"], "left")


def best_judgement(results: DataFrame, metric: str, direction: str, name: str) -> DataFrame:
    best = F.max("value") if direction == "desc" else F.min("value")
    return results.where(F.col("metric") == metric).groupBy("record_id", "run_id").agg(best.alias(name))


def cells(results: DataFrame) -> DataFrame:
    """Judgements of a run as one array in their order."""
    item = F.struct("ordinal", "metric", "value")
    return results.groupBy("record_id", "run_id").agg(F.array_sort(F.collect_list(item)).alias("results"))


def project(runs: DataFrame, words: filters.Vocabulary, where: dict | None, sort: list[tuple[str, str]], used: DataFrame | None = None, member: bool = False, include: set[str] = frozenset(), limit: int = paging.USUAL, cursor: list | None = None, extra=lambda rows: rows) -> DataFrame:
    """Mask, join keys (``extra``), filter, keyset, page."""
    rows = extra(masked(admitted(runs, used, member, include), member))
    keys = paging.with_tie(sort, "run_id", [("run_id", "asc")])
    return paging.page(filters.apply(rows, where, words), keys, limit, cursor)


def summary(runs: DataFrame, member: bool) -> DataFrame:
    """Counts per set; archived and deleted ones are null for others."""
    gone, filed = F.col("tombstoned"), F.col("archived") & ~F.col("tombstoned")
    up = ~gone & ~F.col("archived")
    mine = lambda c: F.when(F.lit(member), F.count_if(c))
    return runs.groupBy("record_id").agg(
        F.count_if(up).alias("live"), F.count_if(up & (F.col("status") == "ok")).alias("ok"), F.count_if(up & (F.col("status") == "error")).alias("error"),
        F.count_if(up & (F.col("status") == "skipped")).alias("skipped"), mine(filed).alias("archived_runs"), mine(gone).alias("deleted"), F.count("*").alias("total"),
    )


def runs_hash(runs: DataFrame) -> DataFrame:
    """The set hash of each record's runs, archived and deleted ones too."""
    return canon.set_hashes(runs, "record_id", "run_id", "content_hash").withColumnRenamed("content_hash", "runs_hash")


def used_summary(used: DataFrame, runs: DataFrame) -> DataFrame:
    """Per set: how many runs were used, the set hash now and then, and which changed since."""
    both = used.join(runs.select("record_id", "run_id", "content_hash"), ["record_id", "run_id"])
    other = F.when(F.col("posted_hash") != F.col("content_hash"), F.col("run_id"))
    counted = both.groupBy("record_id").agg(F.count("*").alias("runs_used"), F.array_sort(F.collect_list(other)).alias("changed"))
    hashed = canon.set_hashes(both, "record_id", "run_id", "content_hash", "posted_hash").withColumnRenamed("content_hash", "used_hash")
    return counted.join(hashed, "record_id").select("record_id", "runs_used", "used_hash", "posted_hash", "changed")


def same_all(used: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Whether the used set is not empty and each run has the card's own print; a missing one differs.

    used: record_id, run_id. mine: record_id, fingerprint. theirs: record_id, run_id, fingerprint.
    """
    rows = mine.withColumnRenamed("fingerprint", "own").join(used, "record_id", "left").join(theirs, ["record_id", "run_id"], "left")
    equal = F.coalesce(F.col("fingerprint") == F.col("own"), F.lit(False))
    return rows.groupBy("record_id").agg(((F.count("run_id") > 0) & F.bool_and(equal)).alias("same"))
