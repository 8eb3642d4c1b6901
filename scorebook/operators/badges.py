"""Badges: facts about a version that hold or do not, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from . import derive

# The badges in their order.
BADGES = ["refs_resolved", "harness_registered", "metric_registered", "env_pinned", "redacted"]
FACTS = BADGES[:3]


def asked(bodies: DataFrame) -> DataFrame:
    """version_id and what badges ask of a body, which is parsed once: harness and version, and whether env_pinned and redacted hold."""
    v = F.col("v")
    read = {"harness": jsonx.json_str(v, "$.harness.name"), "version": jsonx.json_str(v, "$.harness.version"), "env_pinned": env_pinned(v), "redacted": jsonx.json_bool(v, "$.redaction.applied")}
    return bodies.select("version_id", F.try_parse_json("body").alias("v")).select("version_id", *[c.alias(n) for n, c in read.items()])


def refs_resolved(edges: DataFrame) -> DataFrame:
    """Per version with edges whether each is resolved or points outside."""
    outside = F.col("to_external").startswith("external:") | F.col("to_external").startswith("hf:")
    return edges.groupBy(F.col("from_version_id").alias("version_id")).agg(F.bool_and(F.coalesce(F.col("to_version_id").isNotNull() | outside, F.lit(False))).alias("refs_resolved"))


def metrics_registered(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Per version with results whether each metric ``ns/id`` is an entry, of any version."""
    known = registry.where("kind = 'metrics'").select(F.concat("ns", F.lit("/"), "id").alias("metric")).distinct().withColumn("known", F.lit(True))
    cited = results.select("version_id", "metric").distinct().join(known, "metric", "left")
    return cited.groupBy("version_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("metric_registered"))


def harness_registered(registry: DataFrame) -> DataFrame:
    """The harnesses ``ns/id`` that are entries, with exactly their versions."""
    known = registry.where("kind = 'harnesses'").select(F.concat("ns", F.lit("/"), "id").alias("harness"), "version")
    return known.distinct().withColumn("harness_registered", F.lit(True))


def facts(asked: DataFrame, edges: DataFrame, results: DataFrame, registry: DataFrame) -> DataFrame:
    """The rows of ``asked`` with the three facts that the registry and the edges tell; true of metrics and references where there are none."""
    # few harnesses have very many versions each, which a shuffle by harness would put into a few tasks; entries are few
    rows = asked.join(F.broadcast(harness_registered(registry)), ["harness", "version"], "left")
    for found in (refs_resolved(edges), metrics_registered(results, registry)):
        rows = rows.join(found, "version_id", "left")
    return rows.withColumns({n: F.coalesce(n, F.lit(n != "harness_registered")) for n in FACTS})


def env_pinned(v: Column) -> Column:
    """A clean commit, and a sandbox image by digest."""
    filled = lambda p: F.coalesce(jsonx.json_str(v, p) != "", F.lit(False))
    return F.coalesce(~jsonx.json_bool(v, "$.env.git.dirty"), F.lit(False)) & filled("$.env.git.commit") & filled("$.trial.sandbox.digest")


def badges(known: DataFrame) -> DataFrame:
    """version_id, badges of what ``asked`` and ``facts`` tell; a body that is gone keeps those that the facts tell."""
    return known.select("version_id", derive.badges({n: F.col(n) for n in BADGES}).alias("badges"))
