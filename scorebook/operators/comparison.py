"""Cards that use an eval version, side by side: prints, whether their runs agree with them, and their used sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from ..sources.staged import keep
from .records import visible


def users(evals: DataFrame, edges: DataFrame, targets: DataFrame, caller: list[str]) -> DataFrame:
    """eval_version_id, eval_record_id and the columns of each card whose latest live version uses that eval version, by id or by its
    address as text; two equi-joins, not one on either."""
    mine = evals.select(F.col("version_id").alias("eval_version_id"), F.col("record_id").alias("eval_record_id"), F.col("address").alias("eval_address"))
    use = edges.where("type = 'core/uses_eval'").select("from_version_id", "to_version_id", "to_external")
    by_id = use.where("to_version_id is not null").join(mine, F.col("to_version_id") == F.col("eval_version_id")).select("from_version_id", "eval_version_id", "eval_record_id")
    by_text = use.where("to_external is not null").join(mine, F.col("to_external") == F.col("eval_address")).select("from_version_id", "eval_version_id", "eval_record_id")
    live = targets.where(~F.col("tombstoned") & (F.col("type") == "card") & visible(caller))
    last = targets.where(~F.col("tombstoned")).groupBy("record_id").agg(F.max_by("version_id", "seq").alias("version_id"))
    cards = live.join(last.select("version_id"), "version_id", "left_semi").select("version_id", "ns", "name", "seq", "content_hash")
    return by_id.unionByName(by_text).distinct().join(cards, F.col("from_version_id") == F.col("version_id")).drop("from_version_id")


def compare(evals: DataFrame, edges: DataFrame, targets: DataFrame, prints: DataFrame, used: DataFrame, runs: DataFrame, run_prints: DataFrame, caller: list[str]) -> DataFrame:
    """``users`` with their prints as a map, ``same_harness`` and ``same_model`` (all used runs, at least one, have the card's own
    print), the number of used runs, their set hash now, and the ids of those that changed since.

    prints: version_id, facet, fingerprint. used: version_id, eval_record_id, run_id, posted_hash. runs: record_id, run_id,
    content_hash. run_prints: record_id, run_id, facet, fingerprint.
    """
    rows = keep(users(evals, edges, targets, caller))
    own = prints.groupBy("version_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("facet", "fingerprint")))).alias("fingerprints"))
    facet = lambda name: F.max(F.when(F.col("facet") == name, F.col("fingerprint")))
    theirs = run_prints.where("facet in ('harness', 'model')").groupBy("record_id", "run_id").agg(facet("harness").alias("harness"), facet("model").alias("model"))
    mine = prints.groupBy("version_id").agg(facet("harness").alias("own_harness"), facet("model").alias("own_model"))
    pairs = rows.select("version_id", "eval_record_id").distinct()
    members = used.join(pairs, ["version_id", "eval_record_id"], "left_semi").withColumnRenamed("eval_record_id", "record_id").join(runs.select("record_id", "run_id", "content_hash"), ["record_id", "run_id"])
    members = members.join(theirs, ["record_id", "run_id"], "left").join(mine, "version_id", "left")
    key = F.to_json(F.struct("version_id", "record_id"))
    members = keep(members.withColumn("set", key))
    same = lambda name: F.bool_and(F.coalesce(F.col(name) == F.col(f"own_{name}"), F.lit(False)))
    counted = members.groupBy("version_id", "record_id", "set").agg(
        F.count("*").alias("runs_used"), same("harness").alias("same_harness"), same("model").alias("same_model"), F.array_sort(F.collect_list(F.when(F.col("posted_hash") != F.col("content_hash"), F.col("run_id")))).alias("changed"),
    )
    hashed = canon.set_hashes(members, "set", "run_id", "content_hash").withColumnRenamed("content_hash", "used_set_hash")
    sums = counted.join(hashed, "set").drop("set").withColumnRenamed("record_id", "eval_record_id")
    out = rows.join(own, "version_id", "left").join(sums, ["version_id", "eval_record_id"], "left")
    return out.select(
        "eval_version_id", "version_id", "ns", "name", "seq", "content_hash", "fingerprints", F.coalesce("same_harness", F.lit(False)).alias("same_harness"), F.coalesce("same_model", F.lit(False)).alias("same_model"),
        F.coalesce("runs_used", F.lit(0)).alias("runs_used"), F.coalesce("used_set_hash", F.sha2(F.lit("[]"), 256)).alias("used_set_hash"), F.coalesce("changed", F.array().cast("array<string>")).alias("changed"),
    )


def grouped(rows: DataFrame, facet: str) -> DataFrame:
    """Compared cards of each eval version by their print of a facet: eval_version_id, fingerprint (null first), items in order of name."""
    item = F.struct("ns", "name", "version_id")
    found = rows.withColumn("fingerprint", F.try_element_at("fingerprints", F.lit(facet)))
    return found.groupBy("eval_version_id", "fingerprint").agg(F.array_sort(F.collect_list(item)).alias("items"))
