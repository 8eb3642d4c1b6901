"""Bodies cut into side tables, batches read, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx

#: The part of a body that is cut into rows.
BODY = (
    "struct<results:array<struct<metric:string,value:double,n:bigint,aggregation:string>>,"
    "relations:array<struct<type:string,to:string,attrs:string>>,"
    "attachments:array<struct<path:string,sha256:string,size:bigint,media_type:string>>,"
    "run_results:array<struct<eval:string,run_id:string,metric:string,value:double,label:string>>>"
)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One JSON body a line, as text; the text stays beside anything parsed, since absent and null differ."""
    return spark.read.text(path).select(F.col("value").alias("body"))


def read_batch(spark: SparkSession, path: str, limit: int = 1000) -> DataFrame:
    """The runs of {"runs": [...]} documents, one row each with its place; longer batches are refused."""
    runs = spark.read.text(path, wholetext=True).select(F.from_json("value", "runs array<string>").alias("b"), F.col("_metadata.file_path").alias("batch"))
    checked = F.when(F.size("b.runs") > limit, F.raise_error(F.lit("413: too many runs"))).otherwise(F.col("b.runs"))
    return runs.select("batch", F.posexplode(checked).alias("position", "run"))


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """path, size and sha256 of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def side_tables(bodies: DataFrame) -> dict[str, DataFrame]:
    """The arrays of each body (version_id, body) as tables with ordinals."""
    parsed = bodies.select("version_id", F.from_json("body", BODY).alias("b"))

    def cut(name: str) -> DataFrame:
        return parsed.select("version_id", F.posexplode(f"b.{name}").alias("ordinal", "e")).select("version_id", "ordinal", "e.*")

    return {name: cut(name) for name in ("results", "relations", "attachments", "run_results")}


def append(tables: dict[str, DataFrame], root: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("append").parquet(f"{root}/{name}")


def bodies_of(versions: DataFrame, results: DataFrame) -> DataFrame:
    """Versions with their results folded back into one JSON body, results in a total order."""
    item = F.struct("metric", "value", F.col("n").cast("long").alias("n"), "aggregation")
    folded = results.groupBy("version_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    return versions.join(folded, "version_id").select("version_id", F.to_json(F.struct("model_id", "results")).alias("body"))


def model_index(bodies: DataFrame, maker: str) -> DataFrame:
    """version_id, yaml, code: the results of each body (version_id, subject, url, body) as a model-index entry.

    One result with all metrics in their order, those without a text for a metric or a number for a value left out; a body
    without any is a bad_request. Texts are quoted as JSON, which YAML reads alike.
    """
    v = F.col("v")
    text = lambda p, other: F.coalesce(jsonx.json_str(v, p), F.lit(other))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"\A\[|\]\z", "")
    results = F.coalesce(F.try_variant_get(v, "$.results", "array<variant>"), F.array().cast("array<variant>"))
    named = F.filter(results, lambda r: jsonx.json_str(r, "$.metric").isNotNull() & jsonx.json_num(r, "$.value").isNotNull())
    metric = lambda r: F.concat(F.lit("    - type: "), quoted(jsonx.json_str(r, "$.metric")), F.lit("\n      value: "), F.to_json(F.variant_get(r, "$.value", "variant")), F.lit("\n      name: "), quoted(jsonx.json_str(r, "$.metric")))
    rows = bodies.withColumn("v", F.try_parse_json("body")).withColumn("metrics", F.transform(named, metric))
    task, split = quoted(text("$.task.id", "unknown")), jsonx.json_str(v, "$.task.split")
    both = lambda head: F.concat(F.lit(f"{head}:\n      type: "), task, F.lit("\n      name: "), task)
    yaml = F.concat(
        F.lit("model-index:\n- name: "), quoted(text("$.model.id", "unknown")), F.lit("\n  results:\n  - "), both("task"), F.lit("\n    "), both("dataset"),
        F.when(split.isNotNull(), F.concat(F.lit("\n      split: "), quoted(split))).otherwise(""), F.lit("\n    metrics:\n"), F.array_join("metrics", "\n"),
        F.lit("\n    source:\n      name: "), quoted(F.concat(F.lit(f"{maker} "), F.col("subject"))), F.when(F.col("url").isNotNull(), F.concat(F.lit("\n      url: "), quoted(F.col("url")))).otherwise(""), F.lit("\n"),
    )
    filled = F.size("metrics") > 0
    return rows.select("version_id", F.when(filled, yaml).alias("yaml"), F.when(~filled, "bad_request").alias("code"))
