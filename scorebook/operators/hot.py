"""Hot keys of a body as typed columns, cut out once at ingest, and typed reads below the rest of it.

A filter on a hot key then prunes row groups and never reads the body. A value of the wrong type is null, as is an absent one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx

# The columns, their paths in a body, and their types.
COLUMNS = {
    "title": ("title", "text"), "producer_name": ("producer.name", "text"), "model_id": ("model.id", "text"), "model_provider": ("model.provider", "text"), "model_revision": ("model.revision", "text"),
    "task_id": ("task.id", "text"), "task_version": ("task.version", "text"), "task_split": ("task.split", "text"), "harness_name": ("harness.name", "text"), "harness_version": ("harness.version", "text"),
    "gen_temperature": ("generation.temperature", "number"), "gen_top_p": ("generation.top_p", "number"), "gen_max_tokens": ("generation.max_tokens", "number"), "trial_k": ("trial.k", "number"),
    "env_git_commit": ("env.git.commit", "text"), "env_git_dirty": ("env.git.dirty", "boolean"),
}
READS = {"number": jsonx.json_num, "string": jsonx.json_str, "boolean": jsonx.json_bool}


def below(v: Column, segments: list[str], kind: str) -> Column:
    """The typed value under the keys, such as ["ext", "ns/name", "k"] or ["model", "id"] of a run; kind: number, string or boolean."""
    return READS[kind](v, jsonx.path(*segments))


def as_text(v: Column, segments: list[str]) -> Column:
    """The value as text, whatever its type; null for an absent one and a JSON null."""
    found = F.variant_get(v, jsonx.path(*segments), "variant")
    return F.coalesce(jsonx.json_str(found, "$"), F.when(~F.is_variant_null(found), F.to_json(found)))


def with_columns(bodies: DataFrame, column: str = "body") -> DataFrame:
    """The bodies with all hot columns."""
    parsed = bodies.withColumn("_v", F.try_parse_json(column))
    made = {name: as_text(F.col("_v"), path.split(".")) if kind == "text" else below(F.col("_v"), path.split("."), kind) for name, (path, kind) in COLUMNS.items()}
    return parsed.withColumns(made).drop("_v")


def write(bodies: DataFrame, path: str, cluster: list[str], files: int | None = None) -> None:
    """Bodies with their hot columns, in ranges of the keys that filters name most; extra keys (``ext``) may be columns already."""
    rows = with_columns(bodies)
    dealt = rows.repartitionByRange(files, *cluster) if files else rows.repartitionByRange(*cluster)
    dealt.sortWithinPartitions(*cluster).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
