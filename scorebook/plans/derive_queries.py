"""Queries of derived data: validation, badges, hashes, ingest and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon
from ..operators import derive
from ..operators import records as rec
from ..sources import carriers as c
from ..sources import ingest


def der_changed(spark, d):
    return rec.changed(c.versions(spark, d), ["model_id", "env", "temperature"]).select("version_id", "seq", F.array_join("changed", ",").alias("changed"))


def der_changed_turns(spark, d):
    """Roles that differ from the turn before."""
    t = c.table(spark, d, "conversations").select(F.col("conv_id").alias("record_id"), F.col("turn").alias("seq"), F.col("turn").alias("version_id"), "role", F.lit(False).alias("tombstoned"))
    return rec.changed(t, ["role"]).select("record_id", "seq", F.array_join("changed", ",").alias("changed"))


def der_badge_sweep(spark, d):
    """Versions whose registered badge changes once metric N is registered too."""
    before = derive.all_registered(c.results(spark, d), c.registry(spark, d)).withColumnRenamed("registered", "old")
    known = c.registry(spark, d).unionByName(spark.range(1).select(F.lit("metrics").alias("kind"), F.lit("N").alias("id")))
    after = derive.all_registered(c.results(spark, d), known)
    return after.join(before, "version_id").where(~F.col("old").eqNullSafe(F.col("registered"))).select("version_id", "old", "registered")


def citing_metric(spark, d):
    return derive.citing(c.results(spark, d), "N")


def der_idempotent(spark, d):
    """Events whose body is that of the user's event before: nothing would be written."""
    from pyspark.sql import Window

    b = c.bodies(spark, d).withColumn("h", F.sha2("body", 256))
    before = Window.partitionBy("record_id").orderBy("created_at", "version_id")
    return b.withColumn("same", F.coalesce(F.lag("h").over(before) == F.col("h"), F.lit(False))).where("same").select("version_id", "record_id")


def agg_fold_last(spark, d):
    return derive.last_wins(c.bodies(spark, d).select("record_id", "type", "version_id", "body"), ["record_id", "type"], "version_id")


def der_gc(spark, d):
    objects = c.table(spark, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), F.col("o_orderdate").alias("created_at"))
    refs = c.table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.sha2(F.col("l_orderkey").cast("string"), 256).alias("sha256"))
    more = c.table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.sha2(F.col("l_orderkey").cast("string"), 256).alias("sha256"))
    return derive.unreferenced(objects, "created_at", F.lit("2000-01-01").cast("timestamp"), refs, more)


def sink_side_tables(spark, d):
    """Bodies made of the results and cut again: the rows that went in."""
    bodies = ingest.bodies_of(c.versions(spark, d), c.results(spark, d))
    rows = ingest.side_tables(bodies)["results"]
    return rows.groupBy("version_id").agg(F.count("*").alias("results"), F.max("ordinal").cast("long").alias("last"), F.max("value").alias("best"), F.min("n").alias("least_n"))


def sink_audit(spark, d):
    """Audit rows of all writes, with ids that grow by time."""
    from ..sources.audit import numbered

    return numbered(c.bodies(spark, d).select("version_id", "type", "created_at"), ["created_at", "version_id"])


def fn_jcs(spark, d):
    return c.bodies(spark, d).select("version_id", canon.canonical_json(F.col("body")).alias("canonical"))


def fn_content_hash(spark, d):
    return c.bodies(spark, d).select("version_id", canon.content_hash(F.col("body")).alias("digest"))


def fn_fingerprint(spark, d):
    """Facet prints of bodies that hold a model alone; other facets count as {}."""
    body = F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("id"), F.lit(8).alias("context_window")).alias("model")))
    rows = c.table(spark, d, "orders").select("o_orderkey", F.explode(canon.fingerprints(body)).alias("f"))
    return rows.select("o_orderkey", "f.facet", "f.fingerprint")


def _status(outcome):
    """Outcomes of the old body form as statuses of runs."""
    return F.when(outcome == "error", "error").when(outcome == "view", "skipped").otherwise("ok")


def der_split_v1(spark, d):
    """Old bodies with runs in them, cut into runs: of equal ids in a record the last wins."""
    cut = c.bodies(spark, d).select("record_id", F.get_json_object("body", "$.k").alias("run_id"), "version_id", _status(F.col("type")).alias("status"))
    return derive.last_wins(cut, ["record_id", "run_id"], "version_id").select("record_id", "run_id", "status")


SQL = {
    "der_split_v1": "select record_id, json_extract_string(body, '$.k') as run_id, max_by(case type when 'error' then 'error' when 'view' then 'skipped' else 'ok' end, version_id) as status from bodies group by 1, 2",
    "der_changed": "select version_id, seq, concat_ws(',', case when p is null or env is distinct from pe then 'env' end, case when p is null or model_id is distinct from pm then 'model_id' end, case when p is null or temperature is distinct from pt then 'temperature' end) as changed from (select *, lag(version_id) over w as p, lag(env) over w as pe, lag(model_id) over w as pm, lag(temperature) over w as pt from versions where not tombstoned window w as (partition by record_id order by seq))",
    "der_changed_turns": "select conv_id as record_id, turn as seq, case when lag(role) over (partition by conv_id order by turn) is distinct from role then 'role' else '' end as changed from conversations",
    "der_badge_sweep": "select version_id, false as old, true as registered from results group by 1 having not bool_and(metric in (select id from registry))",
    "citing_metric": "select distinct version_id from results where metric = 'N'",
    "der_idempotent": "select version_id, record_id from (select *, lag(body) over (partition by record_id order by created_at, version_id) as before from bodies) where before = body",
    "agg_fold_last": "select record_id, type, max(version_id) as version_id, max_by(body, version_id) as body from bodies group by 1, 2",
    "der_gc": "select sha256(cast(o_orderkey as varchar)) as sha256, o_orderdate as created_at from orders where o_orderdate < timestamp '2000-01-01' and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A') and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F')",
    "sink_side_tables": "select version_id, count(*) as results, count(*) - 1 as last, max(value) as best, cast(min(n) as bigint) as least_n from results where version_id in (select version_id from versions) group by 1",
    "sink_audit": "select version_id, type, created_at, row_number() over (order by created_at, version_id) as audit_id from bodies",
    "fn_jcs": "select version_id, replace(body, ': ', ':') as canonical from bodies",
    "fn_content_hash": "select version_id, sha256(replace(body, ': ', ':')) as digest from bodies",
    "fn_fingerprint": "select o_orderkey, facet, case when facet = 'model' then sha256('{\"id\":\"' || o_orderpriority || '\"}') else sha256('{}') end as fingerprint from orders, (select unnest(['model', 'task', 'harness', 'generation', 'trial', 'grading', 'env']) as facet)",
}
QUERIES = {name: globals()[name] for name in SQL}
ORACLES = {name: c.sql(text) for name, text in SQL.items()}
