"""Deterministic views of the driver tables, shaped like the tables of an evaluation registry.

The SQL of each view is its counterpart for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("ns"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, "private").otherwise("public").alias("visibility"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_record = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("record_id"),
        F.row_number().over(in_record).cast("long").alias("seq"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderstatus") == "P").alias("tombstoned"), F.col("o_orderpriority").alias("model_id"),
        F.col("o_totalprice").alias("temperature"), F.col("o_orderstatus").alias("env"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("version_id"), F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("aggregation"),
        F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("n"),
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets model and env; versions without a specified priority have none."""
    facet = lambda name, column: F.struct(F.lit(name).alias("facet"), F.sha2(F.col(column), 256).alias("fingerprint"))
    return (
        table(spark, sf_dir, "orders").where("o_orderpriority <> '4-NOT SPECIFIED'")
        .select(F.col("o_orderkey").alias("version_id"), F.explode(F.array(facet("model", "o_orderpriority"), facet("env", "o_orderstatus"))).alias("f"))
        .select("version_id", "f.facet", "f.fingerprint")
    )


def edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Typed edges, each once unless repeats are asked for: orders use parts, parts come from suppliers, suppliers are in nations, nations in regions."""
    lines, key = table(spark, sf_dir, "lineitem"), lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    uses = lines.select(key("o:", "l_orderkey").alias("from_id"), F.lit("uses").alias("type"), key("p:", "l_partkey").alias("to_id"))
    made = lines.select(key("p:", "l_partkey").alias("from_id"), F.lit("made_by").alias("type"), key("s:", "l_suppkey").alias("to_id"))
    near = table(spark, sf_dir, "supplier").select(key("s:", "s_suppkey").alias("from_id"), F.lit("in").alias("type"), key("n:", "s_nationkey").alias("to_id"))
    part = table(spark, sf_dir, "nation").select(key("n:", "n_nationkey").alias("from_id"), F.lit("in").alias("type"), key("r:", "n_regionkey").alias("to_id"))
    every = uses.unionByName(made).unionByName(near).unionByName(part)
    return every if repeats else every.distinct()


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("record_id"), F.col("doc_id").cast("string").alias("run_id"),
        F.when(F.col("n_chars") < 200, "error").when(F.col("lang") == "es", "skipped").otherwise("ok").alias("status"),
        F.when(F.col("n_chars") < 200, F.concat(F.lit("kind"), (F.col("doc_id") % 3).cast("string"))).alias("error_kind"),
        (F.col("doc_id") % 11 == 0).alias("archived"), (F.col("doc_id") % 13 == 0).alias("tombstoned"),
        F.sha2(F.col("text"), 256).alias("content_hash"), F.col("lang"), F.col("doc_id"),
    )


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("n_chars >= 200")
    return d.select(F.col("source").alias("record_id"), F.col("doc_id").cast("string").alias("run_id"), F.lit("core/chars").alias("metric"), F.col("n_chars").cast("double").alias("value"))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements: two rows per labelled document."""
    judged = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    one = lambda i, name: F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
    return judged.select(F.col("source").alias("record_id"), F.col("doc_id").cast("string").alias("run_id"), F.explode(F.array(one(0, "quality"), one(1, "toxic"))).alias("j")).select("record_id", "run_id", "j.*")


def used_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs a card used, with the hash they had then; some have changed since."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    hashed = F.when(F.col("doc_id") % 17 == 0, F.sha2(F.col("lang"), 256)).otherwise(F.sha2(F.col("text"), 256))
    return d.select(F.col("source").alias("record_id"), F.col("doc_id").cast("string").alias("run_id"), hashed.alias("posted_hash"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("version_id"), F.col("user_id").alias("record_id"), F.col("event_type").alias("type"), F.col("props").alias("body"), F.col("ts").alias("created_at"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered metrics: all but one of those in use."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.lit("metrics").alias("kind"), F.col("l_returnflag").alias("id")).distinct()


def hub_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with slugs for names; a card and an eval may share one."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("record_id"), F.when(F.col("c_custkey") % 2 == 0, "card").otherwise("eval").alias("type"), F.lower("c_mktsegment").alias("ns"),
        F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("name"), F.when(F.col("c_acctbal") < 2000, "private").otherwise("public").alias("visibility"),
    )


def hub_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("version_id", "record_id", "seq", "created_at", "tombstoned", F.sha2(F.concat(F.lit("body"), F.col("version_id").cast("string")), 256).alias("content_hash"))


def hub_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub_versions(spark, sf_dir).join(hub_records(spark, sf_dir), "record_id").withColumn("address", F.concat("ns", F.lit("/"), "name", F.lit("@"), F.col("seq").cast("string")))


def relations(spark: SparkSession, sf_dir: str, targets: DataFrame | None = None) -> DataFrame:
    """Edges of a version in their order: resolved ones, addresses as text (some of nothing), external and other text, and repeats.

    ``targets``: the rows of ``hub_targets``, if they are at hand.
    """
    line = F.col("l_linenumber")
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    known = (hub_targets(spark, sf_dir) if targets is None else targets).select((F.col("version_id") - 1).alias("l_partkey"), "address")
    text = F.when(line == 7, F.concat(F.lit("nowhere/none@"), F.col("l_suppkey").cast("string"))).when(line % 3 == 1, F.col("address"))
    text = F.when(line == 2, F.concat(F.lit("external:part/"), F.col("l_partkey").cast("string"))).when(line == 5, F.concat(F.lit("hf:org/set@"), F.col("l_partkey").cast("string"))).otherwise(text)
    return table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left").select(
        F.col("l_orderkey").alias("from_version_id"), (F.row_number().over(at) - 1).alias("ordinal"),
        F.when(F.col("l_returnflag") == "A", "core/uses_eval").when(F.col("l_returnflag") == "N", "core/derived_from").otherwise("core/compares").alias("type"),
        F.when(line % 3 == 0, F.col("l_partkey")).alias("to_version_id"), text.alias("to_external"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of a version in their order, each of a run of an eval record."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("version_id"), (F.row_number().over(at) - 1).alias("ordinal"), F.col("l_suppkey").alias("eval_record_id"),
        F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("run_id"), F.lower(F.concat(F.lit("core/"), F.col("l_returnflag"))).alias("metric"), F.col("l_quantity").cast("long").alias("value"),
    )


def attachment_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("version_id"), F.sha2((F.col("l_partkey") % 500).cast("string"), 256).alias("sha256"), F.concat(F.lit("logs/"), F.col("l_linenumber").cast("string"), F.lit(".txt")).alias("path")
    )


LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
SQL = {
    "records": "select c_custkey as record_id, c_mktsegment as ns, c_name as name, case when c_acctbal < 0 then 'private' else 'public' end as visibility from customer",
    "versions": "select o_orderkey as version_id, o_custkey as record_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as seq, o_orderdate as created_at, o_orderstatus = 'P' as tombstoned, o_orderpriority as model_id, o_totalprice as temperature, o_orderstatus as env from orders",
    "results": "select l_orderkey as version_id, l_returnflag as metric, l_linestatus as aggregation, l_extendedprice as value, l_quantity as n from lineitem",
    "fingerprints": "select o_orderkey as version_id, 'model' as facet, sha256(o_orderpriority) as fingerprint from orders where o_orderpriority <> '4-NOT SPECIFIED' union all select o_orderkey, 'env', sha256(o_orderstatus) from orders where o_orderpriority <> '4-NOT SPECIFIED'",
    "edges": "select distinct 'o:' || l_orderkey as from_id, 'uses' as type, 'p:' || l_partkey as to_id from lineitem union select 'p:' || l_partkey, 'made_by', 's:' || l_suppkey from lineitem union select 's:' || s_suppkey, 'in', 'n:' || s_nationkey from supplier union select 'n:' || n_nationkey, 'in', 'r:' || n_regionkey from nation",
    "runs": "select source as record_id, cast(doc_id as varchar) as run_id, case when n_chars < 200 then 'error' when lang = 'es' then 'skipped' else 'ok' end as status, case when n_chars < 200 then 'kind' || (doc_id % 3) end as error_kind, doc_id % 11 = 0 as archived, doc_id % 13 = 0 as tombstoned, sha256(text) as content_hash, lang, doc_id from documents",
    "run_metrics": "select source as record_id, cast(doc_id as varchar) as run_id, 'core/chars' as metric, cast(n_chars as double) as value from documents where n_chars >= 200",
    "run_results": "select d.source as record_id, cast(d.doc_id as varchar) as run_id, x.ordinal, x.metric, x.value from labels l join documents d using (doc_id), lateral (select 0 as ordinal, 'quality' as metric, cast(l.quality as double) as value union all select 1, 'toxic', cast(l.toxic as double)) x",
    "used_runs": "select source as record_id, cast(doc_id as varchar) as run_id, case when doc_id % 17 = 0 then sha256(lang) else sha256(text) end as posted_hash from documents where doc_id in (select doc_id from labels)",
    "bodies": "select event_id as version_id, user_id as record_id, event_type as type, props as body, ts as created_at from events",
    "registry": "select distinct 'metrics' as kind, l_returnflag as id from lineitem where l_returnflag <> 'N'",
    "hub_records": "select c_custkey as record_id, case when c_custkey % 2 = 0 then 'card' else 'eval' end as type, lower(c_mktsegment) as ns, 'c' || (c_custkey // 2) as name, case when c_acctbal < 2000 then 'private' else 'public' end as visibility from customer",
    "hub_versions": "select version_id, record_id, seq, created_at, tombstoned, sha256('body' || version_id) as content_hash from versions",
    "hub_targets": "select v.version_id, v.record_id, v.seq, v.created_at, v.tombstoned, v.content_hash, r.type, r.ns, r.name, r.visibility, r.ns || '/' || r.name || '@' || v.seq as address from hub_versions v join hub_records r on r.record_id = v.record_id",
    "relations": f"select l_orderkey as from_version_id, row_number() over (partition by l_orderkey order by {LINE_ORDER}) - 1 as ordinal, case l_returnflag when 'A' then 'core/uses_eval' when 'N' then 'core/derived_from' else 'core/compares' end as type, case when l_linenumber % 3 = 0 then l_partkey end as to_version_id, case when l_linenumber = 2 then 'external:part/' || l_partkey when l_linenumber = 5 then 'hf:org/set@' || l_partkey when l_linenumber = 7 then 'nowhere/none@' || l_suppkey when l_linenumber % 3 = 1 then t.address end as to_external from lineitem left join hub_targets t on t.version_id = l_partkey + 1",
    "verdicts": f"select l_orderkey as version_id, row_number() over (partition by l_orderkey order by {LINE_ORDER}) - 1 as ordinal, l_suppkey as eval_record_id, 'r' || l_linenumber as run_id, lower('core/' || l_returnflag) as metric, cast(l_quantity as bigint) as value from lineitem where l_linestatus = 'F'",
    "attachment_refs": "select l_orderkey as version_id, sha256(cast(l_partkey % 500 as varchar)) as sha256, 'logs/' || l_linenumber || '.txt' as path from lineitem",
}


def sql(text: str) -> str:
    """The query with the views that it and they name in front."""
    used: set[str] = set()
    open_ = [text]
    while open_:
        now = open_.pop()
        for n in SQL:
            if n not in used and re.search(rf"\b{n}\b", now):
                used.add(n)
                open_.append(SQL[n])
    if not used:
        return text
    views = ", ".join(f"{n} as ({SQL[n]})" for n in SQL if n in used)
    for word in ("with recursive ", "with "):
        if text.startswith(word):
            return f"{word}{views}, {text[len(word):]}"
    return f"with {views} {text}"
