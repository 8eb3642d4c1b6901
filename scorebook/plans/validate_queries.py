"""Queries of validation and badges, over bodies that are made of the tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import badges, validate
from ..sources import carriers as c


def card_bodies(spark, d):
    """A card per order with its lines as results, attachments, relations and judgements; many have faults, by their values."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = c.table(spark, d, "lineitem").withColumn("i", F.row_number().over(at))
    result = F.expr("struct(case when l_returnflag = 'N' then 'N' else concat('core/', lower(l_returnflag)) end as metric, l_extendedprice as value, case when l_tax = 0 then 'mode' else 'mean' end as aggregation, case when l_linenumber % 2 = 0 then concat('logs/', l_linenumber) end as samples_ref)")
    attachment = F.expr("struct(case l_suppkey % 10 when 0 then concat('/abs/', l_partkey) when 1 then 'a/../b' when 2 then '' else concat('logs/', l_linenumber) end as path, sha2(cast(l_partkey as string), 256) as sha256, l_partkey as size)")
    relation = F.expr("struct(case when l_returnflag = 'R' then 'uses' else 'core/uses_eval' end as type, case when l_linestatus = 'F' then concat('ns/e', l_suppkey, '@', l_linenumber) else concat('ns/e', l_suppkey, '@0') end as to)")
    verdict = F.expr("struct(concat('ns/e', l_suppkey) as eval, concat('r', i) as run_id, concat('core/', lower(l_returnflag)) as metric, case when l_discount > 0 then l_discount end as value)")
    parts = {"results": result, "attachments": attachment, "relations": relation, "run_results": verdict}
    # one list of an order's lines, sorted once; a distinct count beside it would gather the lists by supplier first
    rows = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("i", *[x.alias(n) for n, x in parts.items()]))).alias("lines"),
        F.size(F.collect_set("l_suppkey")).alias("attempted"), F.count_if(F.col("l_returnflag") == "A").alias("completed"), F.count_if(F.col("l_returnflag") == "R").alias("failed"),
    ).withColumns({n: F.col(f"lines.{n}") for n in parts})
    body = F.expr(
        """to_json(struct(case when o_orderpriority = '5-LOW' then 'scorebook.card/9' else 'scorebook.card/1.1' end as schema, case when o_orderkey % 7 > 0 then o_orderpriority end as title,
        struct('h' as name, case when o_orderkey % 5 > 0 then '1' end as version) as producer, struct('t' as id, cast(o_orderkey as decimal(20, 0)) * 10000000000000 as n) as task,
        struct(concat('core/h', o_custkey % 3) as name, cast(o_custkey % 2 as string) as version) as harness, struct(struct('c' as commit, o_custkey % 4 = 0 as dirty) as git) as env,
        struct(struct('i' as image, case when o_custkey % 3 > 0 then 'd' end as digest) as sandbox) as trial, struct(o_orderstatus = 'F' as applied) as redaction,
        results, case when o_orderstatus <> 'P' then struct(attempted, completed, failed) end as counts, attachments, relations, run_results, map(case when o_custkey % 2 = 0 then 'a/b' else concat('B~', o_orderstatus) end, o_custkey) as ext))"""
    )
    return c.table(spark, d, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), body.alias("body"))


def run_bodies(spark, d):
    """A run per document, written under its id; many have faults."""
    body = F.expr(
        """to_json(struct(case when doc_id % 17 = 0 then concat('x', doc_id) else cast(doc_id as string) end as run_id, case when n_chars < 200 then 'error' when lang = 'es' then 'skipped' when doc_id % 23 = 0 then 'gone' else 'ok' end as status,
        case when n_chars < 200 or doc_id % 19 = 0 then struct('k' as kind, case when doc_id % 2 = 0 then 'logs/a' else 'logs/b' end as log) end as error, case when lang = 'es' and doc_id % 3 > 0 then 'why' end as skip_reason,
        case when doc_id % 4 = 0 then '2026-01-01 00:00:00Z' else '2026-01-01T00:00:00Z' end as started_at, map(case when doc_id % 6 = 0 then 'Chars' else 'core/chars' end, n_chars) as metrics,
        array(struct('logs/a' as path, 'f' as sha256, 1 as size)) as attachments))"""
    )
    return c.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 29 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("/x"))).otherwise(F.col("doc_id").cast("string")).alias("run_id"), body.alias("body"))


def _errors(kind: str, codes: tuple[str, ...], spark, d):
    bodies = card_bodies(spark, d).withColumn("run_id", F.lit(None).cast("string")) if kind == "card" else run_bodies(spark, d)
    rows = validate.rows_of(validate.errors(bodies.withColumn("body_kind", F.lit(kind))))
    return rows.where(F.col("code").isin(*codes)) if codes else rows


def _known(spark, d):
    """Registered metrics and harnesses, some in several versions."""
    lines, orders = c.table(spark, d, "lineitem"), c.table(spark, d, "orders")
    metrics = lines.where("l_returnflag = 'A'").select(F.lit("metrics").alias("kind"), F.lit("core").alias("ns"), F.lit("a").alias("id"), F.col("l_linestatus").alias("version")).distinct()
    harnesses = orders.where("o_custkey % 3 < 2").select(F.lit("harnesses").alias("kind"), F.lit("core").alias("ns"), F.concat(F.lit("h"), (F.col("o_custkey") % 3).cast("string")).alias("id"), F.lit("1").alias("version")).distinct()
    return metrics.unionByName(harnesses)


def _facts(spark, d):
    bodies = card_bodies(spark, d).withColumnRenamed("id", "version_id")
    results = c.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.concat(F.lit("core/"), F.lower("l_returnflag")).alias("metric"))
    return badges.facts(badges.asked(bodies), c.relations(spark, d), results, _known(spark, d))


def der_facts(spark, d):
    return _facts(spark, d).select("version_id", *badges.FACTS)


def der_badges(spark, d):
    return badges.badges(_facts(spark, d)).select("version_id", F.array_join("badges", ",").alias("badges"))


LINES = f"(select *, row_number() over (partition by l_orderkey order by {c.LINE_ORDER}) - 1 as i, case l_suppkey % 10 when 0 then '/abs/' || l_partkey when 1 then 'a/../b' when 2 then '' else 'logs/' || l_linenumber end as path from lineitem)"
USED = "(select l_orderkey as id, 'ns/e' || l_suppkey as eval from lineitem where l_returnflag <> 'R' and l_linestatus = 'F')"
# The rank of a code among those of one path that can meet.
PLACED = "select id, row_number() over (partition by id order by path, case code when 'schema' then 0 when 'number_too_large' then 1 when 'run_id_invalid' then 2 else 3 end, code) - 1 as place, path, code from ({0})"
CARD_ERRORS = f"""
with l as {LINES}, good as (select *, row_number() over (partition by l_orderkey, path order by i) as nth from l where path like 'logs/%'), e as (
select o_orderkey as id, '/schema' as path, 'schema' as code from orders where o_orderpriority = '5-LOW'
union all select o_orderkey, '', 'schema' from orders where o_orderkey % 7 = 0
union all select o_orderkey, '/producer', 'schema' from orders where o_orderkey % 5 = 0
union all select o_orderkey, '/task/n', 'number_too_large' from orders where o_orderkey * 10000000000000 > 9007199254740992
union all select o_orderkey, '/ext/B~0' || o_orderstatus, 'ext_key_invalid' from orders where o_custkey % 2 = 1
union all select o_orderkey, '/counts', 'counts_missing' from orders where o_orderstatus = 'P' and o_orderkey in (select l_orderkey from l)
union all select o_orderkey, '/counts', 'schema' from orders where o_orderstatus <> 'P' and o_orderkey not in (select l_orderkey from l)
union all select o_orderkey, '/counts', 'counts_inconsistent' from orders join (select l_orderkey, count(distinct l_suppkey) as n, count(*) filter (where l_returnflag in ('A', 'R')) as m from l group by 1) on l_orderkey = o_orderkey where o_orderstatus <> 'P' and n < m
union all select l_orderkey, '/results/' || i || '/metric', 'metric_id_invalid' from l where l_returnflag = 'N'
union all select l_orderkey, '/results/' || i || '/aggregation', 'schema' from l where l_tax = 0
union all select l_orderkey, '/results/' || i || '/samples_ref', 'attachment_ref_unknown' from l where l_linenumber % 2 = 0 and not exists (select 1 from good g where g.l_orderkey = l.l_orderkey and g.path = 'logs/' || l.l_linenumber)
union all select l_orderkey, '/attachments/' || i || '/path', 'attachment_path_invalid' from l where path not like 'logs/%'
union all select l_orderkey, '/attachments/' || i || '/path', 'attachment_path_invalid' from good where nth > 1
union all select l_orderkey, '/relations/' || i || '/type', 'schema' from l where l_returnflag = 'R'
union all select l_orderkey, '/relations/' || i || '/to', 'schema' from l where l_linestatus <> 'F'
union all select l_orderkey, '/run_results/' || i, 'run_result_value_or_label' from l where not l_discount > 0
union all select l_orderkey, '/run_results/' || i || '/eval', 'run_results_eval_unknown' from l where not exists (select 1 from {USED} u where u.id = l.l_orderkey and u.eval = 'ns/e' || l.l_suppkey)
) {PLACED.format('select * from e')}
""".strip()
RUN_ERRORS = PLACED.format(
    "select doc_id as id, '/run_id' as path, 'run_id_invalid' as code from documents where doc_id % 29 = 0 union all select doc_id, '/run_id', 'run_id_mismatch' from documents where doc_id % 29 = 0 or doc_id % 17 = 0"
    " union all select doc_id, '/status', 'schema' from documents where n_chars >= 200 and lang <> 'es' and doc_id % 23 = 0 union all select doc_id, '/error', 'run_status_detail' from documents where n_chars >= 200 and doc_id % 19 = 0 and (lang = 'es' or doc_id % 23 <> 0)"
    " union all select doc_id, '/skip_reason', 'run_status_detail' from documents where (n_chars < 200 and lang = 'es' and doc_id % 3 > 0) or (n_chars >= 200 and lang = 'es' and doc_id % 3 = 0)"
    " union all select doc_id, '/error/log', 'attachment_ref_unknown' from documents where (n_chars < 200 or doc_id % 19 = 0) and doc_id % 2 = 1 union all select doc_id, '/started_at', 'schema' from documents where doc_id % 4 = 0"
    " union all select doc_id, '/metrics/Chars', 'metric_id_invalid' from documents where doc_id % 6 = 0"
)
#: name: (body kind, the codes that it shows)
RULES = {
    "der_validate_record": ("card", ()), "der_validate_run": ("run", ()), "der_counts_rule": ("card", ("counts_missing", "counts_inconsistent")), "der_numbers": ("card", ("number_too_large",)),
    "der_attachment_paths": ("card", ("attachment_path_invalid", "attachment_ref_unknown")), "der_ext_keys": ("card", ("ext_key_invalid",)),
}
FACTS = """
select o.o_orderkey as version_id, coalesce(e.ok, true) as refs_resolved, o.o_custkey % 3 < 2 and o.o_custkey % 2 = 1 as harness_registered, coalesce(m.ok, true) as metric_registered
from orders o left join (select from_version_id, bool_and(to_version_id is not null or coalesce(to_external like 'external:%' or to_external like 'hf:%', false)) as ok from relations group by 1) e on e.from_version_id = o.o_orderkey
left join (select l_orderkey, bool_and(l_returnflag = 'A') as ok from lineitem group by 1) m on m.l_orderkey = o.o_orderkey
""".strip()
SQL = {
    name: f"select * from ({CARD_ERRORS if kind == 'card' else RUN_ERRORS})" + (f" where code in ({', '.join(map(repr, codes))})" if codes else "") for name, (kind, codes) in RULES.items()
} | {
    "der_facts": FACTS,
    "der_badges": f"select f.version_id, concat_ws(',', case when refs_resolved then 'refs_resolved' end, case when harness_registered then 'harness_registered' end, case when metric_registered then 'metric_registered' end, case when o_custkey % 4 <> 0 and o_custkey % 3 > 0 then 'env_pinned' end, case when o_orderstatus = 'F' then 'redacted' end) as badges from ({FACTS}) f join orders on o_orderkey = f.version_id",
}

QUERIES = {name: partial(_errors, *rule) for name, rule in RULES.items()} | {name: globals()[name] for name in ("der_facts", "der_badges")}
ORACLES = {name: c.sql(text) for name, text in SQL.items()}
