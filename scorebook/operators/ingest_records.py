"""Creating and appending versions: checks, numbers, what changed, resolved relations, used sets, badges and side tables.

A batch holds bodies for records that are there, each under a new version id; bodies of one record follow each other by
position. A body with any error is refused with all of them, and the others are written. One that is canonically what the
record's latest live version says is not written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon
from ..sources import ingest
from ..sources.staged import keep
from . import badges, relations, used_sets, validate


@dataclass
class Ingested:
    """New rows of each table, what each body of the batch led to (version_id, outcome), and errors (version_id, place, path, code)."""

    versions: DataFrame
    outcomes: DataFrame
    errors: DataFrame
    relations: DataFrame
    used: DataFrame
    verdicts: DataFrame
    results: DataFrame
    attachment_refs: DataFrame
    fingerprints: DataFrame
    audit: DataFrame


def parts(body: Column) -> Column:
    """map<string, string>: the top-level keys of a body with their values as JSON text; null for no body."""
    whole = F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>")
    return F.transform_values(whole, lambda k, v: F.to_json(v))


def changed(now: Column, before: Column) -> Column:
    """Sorted top-level keys whose values differ between two maps of parts; all of them where there was no version before."""
    keys = F.array_union(F.map_keys(now), F.coalesce(F.map_keys(before), F.array().cast("array<string>")))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(now, k).eqNullSafe(F.try_element_at(before, k))))


def create_or_append(batch: DataFrame, records: DataFrame, versions: DataFrame, runs: DataFrame, registry: DataFrame, ready: DataFrame, writer: list[str]) -> Ingested:
    """batch: position, version_id, record_id, body. records: record_id, type, ns, name, visibility. versions: version_id, record_id, seq,
    body, tombstoned. runs: as used sets read them. registry: kind, ns, id, version. ready: sha256 of objects that are there."""
    versions = keep(versions.select("version_id", "record_id", "seq", "body", "tombstoned"))
    typed = keep(batch.join(records.select("record_id", "type"), "record_id"))
    checked = validate.errors(typed.select(F.col("version_id").alias("id"), F.col("type").alias("body_kind"), F.lit(None).cast("string").alias("run_id"), "body"))
    wrong = keep(checked.select(F.col("id").alias("version_id"), F.explode("errors").alias("e")).select("version_id", "e.path", "e.code"))
    passed = keep(typed.join(wrong.select("version_id").distinct(), "version_id", "left_anti"))
    tables = ingest.side_tables(passed)
    files = tables["attachments"].select("version_id", "ordinal", "path", F.lower("sha256").alias("sha256"))
    missing = files.join(ready.select(F.lower("sha256").alias("sha256")), "sha256", "left_anti").select("version_id", F.concat(F.lit("/attachments/"), F.col("ordinal").cast("string"), F.lit("/sha256")).alias("path"), F.lit("attachment_missing").alias("code"))

    targets = versions.select("version_id", "record_id", "seq").join(records, "record_id")
    written = tables["relations"].select(F.col("to").alias("text"), (F.col("type") == used_sets.USES).alias("_uses")).distinct()
    resolved = relations.resolve_written(written.where("not _uses").select("text"), targets, writer).withColumn("_uses", F.lit(False)).unionByName(
        relations.resolve_written(written.where("_uses").select("text"), targets, writer, "eval").withColumn("_uses", F.lit(True))
    )
    own = targets.select(F.col("version_id").alias("resolved"), F.col("record_id").alias("_record"), F.col("type").alias("_type"))
    # what resolved is joined to its version before the edges are, since the nulls of the others would meet in one task
    resolved = resolved.where("resolved is not null").join(own, "resolved")
    edges = keep(tables["relations"].withColumn("text", F.col("to")).withColumn("_uses", F.col("type") == used_sets.USES).join(resolved, ["text", "_uses"], "left"))
    target = relations.hub_target(F.col("text"))
    card = typed.where("type = 'card'").select("version_id")
    use = edges.join(card, "version_id", "left_semi").select("version_id", "ordinal", "type", target["ns"].alias("ns"), target["name"].alias("name"), F.when(F.col("_type") == "eval", F.col("_record")).alias("eval_record_id"), "attrs")
    fixed = used_sets.fix(use, tables["run_results"].select("version_id", "ordinal", "eval", "run_id", "metric", "value"), runs, records, writer)

    errors = wrong.unionByName(missing).unionByName(fixed.errors.select("version_id", "path", "code"))
    order = F.create_map([F.lit(v) for i, code in enumerate(validate.CODES) for v in (code, i)])
    errors = keep(errors.withColumn("place", F.row_number().over(Window.partitionBy("version_id").orderBy("path", order[F.col("code")])) - 1))
    refused = errors.select("version_id").distinct()

    good = passed.join(refused, "version_id", "left_anti").withColumn("body", canon.canonical_json(F.col("body"))).withColumn("content_hash", F.sha2("body", 256))
    last = versions.where(~F.col("tombstoned")).groupBy("record_id").agg(F.max_by("body", "seq").alias("_body"))
    top = versions.groupBy("record_id").agg(F.max("seq").alias("_seq"))
    in_record = Window.partitionBy("record_id").orderBy("position", "version_id")
    dated = good.join(last, "record_id", "left").join(top, "record_id", "left").withColumn("_before", F.coalesce(F.lag("body").over(in_record), "_body"))
    dated = keep(dated.withColumn("_same", F.coalesce(F.col("_before") == F.col("body"), F.lit(False))))
    fresh = dated.where("not _same").withColumn("seq", F.coalesce("_seq", F.lit(0)) + F.row_number().over(in_record))
    new = keep(fresh.select("version_id", "record_id", "type", F.col("seq").cast("long").alias("seq"), "position", "body", "content_hash", changed(parts(F.col("body")), parts(F.col("_before"))).alias("changed")))

    kept = lambda df: df.join(new.select("version_id"), "version_id", "left_semi")
    stored = kept(edges).select("version_id", "ordinal", "type", F.col("resolved").alias("to_version_id"), F.when(F.col("resolved").isNull(), F.col("text")).alias("to_external"), "attrs")
    results = kept(tables["results"])
    known = badges.facts(badges.asked(new), stored.withColumnRenamed("version_id", "from_version_id"), results, registry)
    marked = new.join(badges.badges(known), "version_id")
    same = dated.where("_same").select("version_id", F.lit("unchanged").alias("outcome"))
    outcomes = new.select("version_id", F.when(F.col("seq") == 1, "created").otherwise("appended").alias("outcome")).unionByName(same).unionByName(refused.withColumn("outcome", F.lit("refused")))
    prints = new.select("version_id", "type", F.explode(canon.fingerprints(F.col("body"))).alias("f")).where("type = 'card' or f.facet <> 'grading'").select("version_id", "f.facet", "f.fingerprint")
    audit = new.select("record_id", "version_id", "seq", F.concat("type", F.lit(".version")).alias("action"), "content_hash")
    return Ingested(marked, outcomes, errors, stored, kept(fixed.used), kept(fixed.verdicts), results, kept(files).select("version_id", "path", "sha256"), prints, audit)
