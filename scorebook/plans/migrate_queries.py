"""Queries of the migration of old evals, over versions that are made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import migrate
from ..sources import carriers as c
from ..sources.staged import Staged, shared_folder

OLD, NEW = "scorebook.eval/1.0", "scorebook.eval/2.0"


def versions(spark, d):
    """Cards and evals; evals of odd numbers hold their runs, one per line, some of them twice in a body and in several versions."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.expr("struct(concat('r', l_linenumber) as run_id, case when l_tax = 0 then 'error' when l_returnflag = 'A' then 'pass' when l_returnflag = 'N' then 'fail' else 'skipped' end as outcome)").alias("r"))
    runs = c.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("version_id")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["r"]).alias("runs"))
    t = c.hub_targets(spark, d).join(runs, "version_id", "left")
    model = F.struct(F.concat(F.lit("m"), (F.col("seq") % 3).cast("string")).alias("id"))
    old = F.to_json(F.struct(model.alias("model"), F.coalesce("runs", F.array().cast("array<struct<run_id:string,outcome:string>>")).alias("runs"), F.lit(OLD).alias("schema")))
    body = F.when((F.col("type") == "eval") & (F.col("seq") % 2 == 1), old).otherwise(F.to_json(F.struct(F.lit(NEW).alias("schema"), F.col("name").alias("title"))))
    return t.select(F.col("record_id").cast("string").alias("record_id"), "version_id", "type", "seq", F.when(~F.col("tombstoned"), body).alias("body"), "content_hash", "tombstoned")


def _edges(spark, d):
    at = F.col("from_version_id") % 3
    cards = c.hub_targets(spark, d).where("type = 'card'").select(F.col("version_id").alias("from_version_id"))
    rows = c.relations(spark, d).where("type = 'core/uses_eval' and to_version_id is not null").join(cards, "from_version_id", "left_semi")
    return rows.select(F.col("from_version_id").alias("version_id"), "to_version_id", F.when(at == 0, '{"runs":["r1","r9"]}').alias("attrs"))


def der_migrate(spark, d):
    """The runs of all old versions as they are then, with the version that each is taken from."""
    made = migrate.cut(versions(spark, d), OLD, NEW)
    return made.where("kind = 'run'").select("version_id", "position", "run_id", F.col("stored").alias("body"))


def op_migrate(spark, d):
    """What the tables hold after the migration has run, and then run again."""
    store = Staged(spark, shared_folder(spark), migrate.TABLES, "record_id", 8)
    store.replace({"versions": versions(spark, d)}, list(range(8)))
    first, again = migrate.migrate(store, _edges(spark, d)), migrate.migrate(store, _edges(spark, d))
    word = lambda *cs: F.concat_ws(" ", *[F.col(x).cast("string") for x in cs])
    rows = store.read("runs").select(F.lit("run").alias("kind"), word("record_id", "run_id", "status", "content_hash").alias("what"))
    heads = store.read("versions").where("type = 'eval' and not tombstoned").select(F.lit("version").alias("kind"), word("version_id", "body").alias("what"))
    used = store.read("used").select(F.lit("used").alias("kind"), word("version_id", "record_id", "run_id", "content_hash").alias("what"))
    lost = store.read("log").where("action = 'migration.card_runs_unmatched'").select(F.lit("unmatched").alias("kind"), word("version_id", "detail").alias("what"))
    ran = spark.createDataFrame([("ran", f"{first.ran} {again.ran}")], "kind string, what string")
    return rows.unionByName(heads).unionByName(used).unionByName(lost).unionByName(ran)


KEPT = f'{{"meta":{{"{migrate.KEPT_KEY}":{{"outcome":"\' || outcome || \'"}}}},"model":{{"id":"m\' || (seq % 3) || \'"}},"run_id":"\' || run_id || \'",'
MADE = f"""
l as (select l_orderkey as version_id, 'r' || l_linenumber as run_id, row_number() over (partition by l_orderkey order by {c.LINE_ORDER}) - 1 as position, case when l_tax = 0 then 'error' when l_returnflag = 'A' then 'pass' when l_returnflag = 'N' then 'fail' else 'skipped' end as outcome from lineitem),
made as (select v.record_id, v.version_id, v.seq, l.position, l.run_id, case outcome when 'error' then 'error' when 'skipped' then 'skipped' else 'ok' end as status,
  case outcome when 'error' then '{{"error":{{"kind":"unrecorded"}},' else '{{' end || '{KEPT[1:]}' || case outcome when 'skipped' then '"skip_reason":"unrecorded","status":"skipped"}}' when 'error' then '"status":"error"}}' else '"status":"ok"}}' end as body
  from hub_targets v join l on l.version_id = v.version_id where v.type = 'eval' and v.seq % 2 = 1 and not v.tombstoned)
""".strip()
MIGRATED = f"""
with {MADE}, own as (select record_id, version_id, seq, run_id, arg_max(status, position) as status, arg_max(sha256(body), position) as h from made group by 1, 2, 3, 4),
best as (select record_id, run_id, arg_max(status, seq) as status, arg_max(h, seq) as h from own group by 1, 2),
moved as (select distinct record_id from hub_targets where type = 'eval' and seq % 2 = 1 and not tombstoned),
edge as (select x.from_version_id as version_id, x.to_version_id, t.record_id from relations x join hub_targets k on k.version_id = x.from_version_id and k.type = 'card' join hub_targets t on t.version_id = x.to_version_id and t.type = 'eval' and not t.tombstoned join moved on moved.record_id = t.record_id where x.type = 'core/uses_eval'),
pointed as (select e.version_id, e.record_id, o.run_id, arg_max(o.h, o.seq) as h from edge e join own o on o.version_id = e.to_version_id group by 1, 2, 3),
named as (select distinct e.version_id, e.record_id, r.run_id from edge e, (values ('r1'), ('r9')) r(run_id) where e.version_id % 3 = 0),
found as (select n.*, coalesce(p.h, b.h) as h from named n left join pointed p on p.version_id = n.version_id and p.record_id = n.record_id and p.run_id = n.run_id left join best b on b.record_id = n.record_id and b.run_id = n.run_id)
select 'run' as kind, record_id || ' ' || run_id || ' ' || status || ' ' || h as what from best
union all select 'version', version_id || ' ' || case when seq % 2 = 1 then '{{"model":{{"id":"m' || (seq % 3) || '"}},"schema":"{NEW}"}}' else '{{"schema":"{NEW}","title":"' || name || '"}}' end from hub_targets where type = 'eval' and not tombstoned
union all select 'used', version_id || ' ' || record_id || ' ' || run_id || ' ' || h from pointed where version_id % 3 <> 0
union all select 'used', version_id || ' ' || record_id || ' ' || run_id || ' ' || h from found where h is not null
union all select 'unmatched', version_id || ' ' || record_id || ' ' || string_agg(run_id, ' ' order by run_id) from found where h is null group by version_id, record_id
union all select 'ran', 'True False'
""".strip()
SQL = {"der_migrate": f"with {MADE} select version_id, position, run_id, body from made", "op_migrate": MIGRATED}
QUERIES = {name: globals()[name] for name in SQL}
ORACLES = {name: c.sql(text) for name, text in SQL.items()}
