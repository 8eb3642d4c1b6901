"""The runs that a card uses, fixed when it is written, and its judgements of them.

An edge ``core/uses_eval`` of a new card version that resolved to an eval uses runs of it: those that its attrs name, over
all the card's edges into that eval, or, if no edge names any, every live run. The hash that a run has then is kept.
Judgements must be of used runs. A card with any error is not written; all its errors are reported.

edges: version_id, ordinal, type, ns, name (of the written target), eval_record_id (of the eval that it resolved to, else
null), attrs (JSON text). verdicts: version_id, ordinal, eval, run_id, metric, value. runs: record_id, run_id, content_hash,
archived, tombstoned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import keep
from .records import visible

USES = "core/uses_eval"


def demoted(edges: DataFrame, records: DataFrame, writer: list[str]) -> DataFrame:
    """The edges; one into an eval that the writer may no longer see is unresolved, as if it had been private before."""
    hidden = records.where(~visible(writer)).select(F.col("record_id").alias("eval_record_id"), F.lit(True).alias("_hidden"))
    asked = edges.where((F.col("type") == USES) & F.col("eval_record_id").isNotNull()).join(hidden, "eval_record_id", "left")
    asked = asked.withColumn("eval_record_id", F.when(F.col("_hidden").isNull(), F.col("eval_record_id"))).select(*edges.columns)
    return asked.unionByName(edges.where((F.col("type") != USES) | F.col("eval_record_id").isNull()))


def uses(edges: DataFrame) -> DataFrame:
    """The edges that use an eval, with the runs that they name: null for none, and null for a name that is no text."""
    found = F.try_variant_get(F.try_parse_json("attrs"), "$.runs", "array<variant>")
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    chosen = edges.where((F.col("type") == USES) & F.col("eval_record_id").isNotNull())
    return chosen.withColumn("named", F.transform(found, text)).select("version_id", "ordinal", "eval_record_id", F.concat("ns", F.lit("/"), "name").alias("eval"), "named")


def named_runs(used: DataFrame) -> DataFrame:
    """The union of the runs that a version's edges into an eval name: version_id, eval_record_id, run_id."""
    return used.select("version_id", "eval_record_id", F.explode("named").alias("run_id")).where("run_id is not null").distinct()


def used_sets(used: DataFrame, runs: DataFrame) -> DataFrame:
    """version_id, eval_record_id, run_id, content_hash: the runs of each version's used sets.

    Of sets that are named archived and deleted runs count; other sets are the live runs.
    """
    rows = runs.select(F.col("record_id").alias("eval_record_id"), "run_id", "content_hash", (~F.col("archived") & ~F.col("tombstoned")).alias("live"))
    sets = used.groupBy("version_id", "eval_record_id").agg(F.bool_or(F.col("named").isNotNull()).alias("explicit"))
    named = named_runs(used).join(rows.drop("live"), ["eval_record_id", "run_id"])
    every = sets.where("not explicit").drop("explicit").join(rows.where("live").drop("live"), "eval_record_id")
    return named.unionByName(every)


@dataclass
class Fixed:
    """What writing cards does: their sets, their judgements with the eval's record, and the errors of those that are refused."""

    used: DataFrame
    verdicts: DataFrame
    errors: DataFrame


def fix(edges: DataFrame, verdicts: DataFrame, runs: DataFrame, records: DataFrame, writer: list[str]) -> Fixed:
    """Used sets, judgements and errors (version_id, path, code, in order of path) of new card versions."""
    using, runs = keep(uses(demoted(edges, records, writer))), keep(runs)
    sets = keep(used_sets(using, runs))
    known = runs.select(F.col("record_id").alias("eval_record_id"), "run_id")
    each = using.select("version_id", "ordinal", "eval_record_id", F.posexplode("named").alias("k", "run_id"))
    path = F.concat(F.lit("/relations/"), F.col("ordinal").cast("string"), F.lit("/attrs/runs/"), F.col("k").cast("string"))
    unknown = each.where("run_id is not null").join(known, ["eval_record_id", "run_id"], "left_anti").select("version_id", path.alias("path"))
    unknown = unknown.unionByName(each.where("run_id is null").select("version_id", path.alias("path"))).withColumn("code", F.lit("run_unknown"))

    # of edges that spell an eval alike the last one counts
    last = using.groupBy("version_id", "eval").agg(F.max_by("eval_record_id", "ordinal").alias("eval_record_id"))
    judged = keep(verdicts.where("eval is not null and run_id is not null and metric is not null").join(last, ["version_id", "eval"], "left"))
    inside = sets.select("version_id", "eval_record_id", "run_id", F.lit(True).alias("_in"))
    there = known.withColumn("_there", F.lit(True))
    own = judged.where("eval_record_id is not null").join(inside, ["version_id", "eval_record_id", "run_id"], "left").where("_in is null").join(there, ["eval_record_id", "run_id"], "left")
    place = F.concat(F.lit("/run_results/"), F.col("ordinal").cast("string"), F.lit("/run_id")).alias("path")
    outside = own.select("version_id", place, F.when(F.col("_there"), "run_not_in_used_set").otherwise("run_unknown").alias("code"))
    nowhere = judged.where("eval_record_id is null").select("version_id", place, F.lit("run_unknown").alias("code"))
    errors = unknown.unionByName(outside).unionByName(nowhere)
    errors = keep(errors.withColumn("place", F.row_number().over(Window.partitionBy("version_id").orderBy("path", "code")) - 1))
    refused = errors.select("version_id").distinct()
    rows = judged.where("eval_record_id is not null").select("version_id", "ordinal", "eval_record_id", "run_id", "metric", "value")
    return Fixed(sets.join(refused, "version_id", "left_anti"), rows.join(refused, "version_id", "left_anti"), errors)


def card_lookup(requests: DataFrame, records: DataFrame, versions: DataFrame, edges: DataFrame, caller: list[str]) -> tuple[DataFrame, DataFrame]:
    """The cards that requests for an eval's runs name, all or nothing: (found, unknown).

    requests: request, position, ns, name, eval_record_id. A card counts if the reader may see it and its latest live version has
    a resolved ``core/uses_eval`` edge into the eval. One that does not empties its whole request, which is then answered by its
    unknown names alone. versions carry record_id, seq and tombstoned; edges from_version_id, type, to_version_id.
    """
    cards = records.where((F.col("type") == "card") & visible(caller)).select("record_id", "ns", "name")
    live = versions.where(~F.col("tombstoned")).groupBy("record_id").agg(F.max_by("version_id", "seq").alias("version_id"), F.max("seq").alias("seq"))
    target = versions.select(F.col("version_id").alias("to_version_id"), F.col("record_id").alias("eval_record_id"))
    into = edges.where((F.col("type") == USES) & F.col("to_version_id").isNotNull()).join(target, "to_version_id").select(F.col("from_version_id").alias("version_id"), "eval_record_id").distinct()
    asked = requests.join(cards, ["ns", "name"], "left").join(live, "record_id", "left")
    checked = asked.join(into.withColumn("uses", F.lit(True)), ["version_id", "eval_record_id"], "left")
    unknown = checked.where("uses is null").select("request", "position", "ns", "name")
    found = checked.where("uses").join(unknown.select("request").distinct(), "request", "left_anti")
    return found.select("request", "position", "ns", "name", "record_id", "version_id", "seq"), unknown
