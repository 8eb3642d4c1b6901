"""Queries of bodies: hot columns and typed reads, exports, and the comparison of cards that use an eval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import comparison, hot, used_sets
from ..sources import carriers as c
from ..sources import ingest
from ..sources.staged import keep, shared_folder
from .relation_queries import CALLER, SEEN
from .write_queries import EVAL_RUNS, _uses, eval_runs


def hot_bodies(spark, d):
    """Bodies of orders; some values are of the wrong type, null or absent."""
    body = F.expr(
        r"""concat('{"title":"', o_orderpriority, '","producer":{"name":"p', o_custkey % 3, '"},', case when o_orderkey % 11 > 0 then concat('"model":{"id":"m', o_custkey % 5, '","provider":', o_custkey, '},') else '' end,
        '"task":{"id":"t', o_orderkey % 7, '","version":null},"generation":{"temperature":', case when o_orderkey % 9 = 0 then '"hot"' else cast(o_totalprice as string) end, ',"top_p":0.5,"max_tokens":', o_orderkey,
        '},"trial":{"k":', o_orderkey % 4, '},"env":{"git":{"commit":"c', o_orderkey, '","dirty":', case when o_orderkey % 13 = 0 then '"yes"' when o_orderkey % 2 = 0 then 'true' else 'false' end,
        '}},"ext":{"a/b":{"rung":', case when o_orderkey % 4 = 0 then '"r"' else cast(o_orderkey % 10 as string) end, ',"q.t/u-v":true}}}')"""
    )
    return c.table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), body.alias("body"))


def proj_generated(spark, d):
    return hot.with_columns(hot_bodies(spark, d)).drop("body")


def proj_ext(spark, d):
    v, at = F.try_parse_json("body"), ["ext", "a/b"]
    return hot_bodies(spark, d).select("version_id", hot.below(v, [*at, "rung"], "number").alias("rung"), hot.below(v, [*at, "rung"], "string").alias("rung_text"), hot.below(v, [*at, "q.t/u-v"], "boolean").alias("flag"))


def proj_run_body(spark, d):
    """Typed reads below the bodies of runs."""
    body = F.expr("""concat('{"model":{"id":', case when doc_id % 3 = 0 then '7' else concat('"', lang, '"') end, '},"generation":{"temperature":', n_chars, '},"env":{"git":{"dirty":', case when doc_id % 2 = 0 then 'true' else '0' end, '}}}')""")
    v = F.try_parse_json(body)
    return c.table(spark, d, "documents").select("doc_id", hot.below(v, ["model", "id"], "string").alias("model_id"), hot.below(v, ["generation", "temperature"], "number").alias("temperature"), hot.below(v, ["env", "git", "dirty"], "boolean").alias("dirty"))


def flt_hot_columns(spark, d):
    """Filters on hot columns of stored bodies; what they find is what reads of the bodies find."""
    path = shared_folder(spark)
    hot.write(hot_bodies(spark, d), path, ["model_id", "task_id"])
    return hot.read(spark, path).where("model_id = 'm1' and gen_temperature >= 100000 and not env_git_dirty").select("version_id", "task_id")


def flt_body_below(spark, d):
    v = F.try_parse_json("body")
    rows = hot_bodies(spark, d).where((jsonx.json_str(v, "$.model.id") == "m1") & (jsonx.json_num(v, "$.generation.temperature") >= 100000) & ~jsonx.json_bool(v, "$.env.git.dirty"))
    return rows.select("version_id", jsonx.json_str(v, "$.task.id").alias("task_id"))


def sink_hf_yaml(spark, d):
    """Results of orders as model-index entries, in order; orders without any are refused."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.struct(F.col("l_returnflag").alias("metric"), F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("value")).alias("r"))
    lines = c.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias("results"))
    body = F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("id")).alias("model"), F.struct(F.lit("t").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, 'test "a"').alias("split")).alias("task"), "results"))
    rows = c.table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    subject, url = F.concat(F.lit("card/x@"), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://h/"), F.col("o_orderkey").cast("string")))
    return ingest.model_index(rows.select(F.col("o_orderkey").alias("version_id"), subject.alias("subject"), url.alias("url"), body.alias("body")), "scorebook")


# --- comparison


def _compared(spark, d):
    targets, edges = keep(c.hub_targets(spark, d)), keep(c.relations(spark, d))
    print_ = lambda facet, text: F.struct(F.lit(facet).alias("facet"), F.sha2(text, 256).alias("fingerprint"))
    word = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    v = F.col("version_id")
    prints = targets.where("version_id % 10 > 0").select("version_id", F.explode(F.array(print_("model", word("m", v % 3)), print_("harness", word("h", v % 2)))).alias("p")).select("version_id", "p.*")
    runs = keep(eval_runs(spark, d))
    n = F.substring("run_id", 2, 9).cast("int")
    run_prints = runs.select("record_id", "run_id", F.explode(F.array_compact(F.array(print_("model", word("m", n % 3)), F.when(n % 5 > 0, print_("harness", word("h", n % 2)))))).alias("p")).select("record_id", "run_id", "p.*")
    used = used_sets.used_sets(used_sets.uses(_uses(spark, d)), runs).select("version_id", "eval_record_id", "run_id", F.when(v % 3 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("content_hash")).alias("posted_hash"))
    return comparison.compare(targets.where("type = 'eval'"), edges, targets, prints, used, runs, run_prints, CALLER)


def graph_comparison(spark, d):
    """Cards that use each eval version, with what their used sets say."""
    rows = _compared(spark, d)
    prints = F.array_join(F.transform(F.map_entries("fingerprints"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("eval_version_id", "version_id", "ns", "name", "seq", "content_hash", prints.alias("fingerprints"), "same_harness", "same_model", "runs_used", "used_set_hash", F.array_join("changed", ",").alias("changed"))


def agg_group_by_fp(spark, d):
    """The compared cards of each eval version by their model's print, in order of name."""
    items = F.array_join(F.transform("items", lambda x: F.concat(x["ns"], F.lit("/"), x["name"], F.lit(" "), x["version_id"].cast("string"))), ",")
    return comparison.grouped(_compared(spark, d), "model").select("eval_version_id", "fingerprint", items.alias("items"))


HOT = "o_orderkey as version_id, o_orderpriority as title, 'p' || (o_custkey % 3) as producer_name, case when o_orderkey % 11 > 0 then 'm' || (o_custkey % 5) end as model_id, case when o_orderkey % 11 > 0 then cast(o_custkey as varchar) end as model_provider, cast(null as varchar) as model_revision, 't' || (o_orderkey % 7) as task_id, cast(null as varchar) as task_version, cast(null as varchar) as task_split, cast(null as varchar) as harness_name, cast(null as varchar) as harness_version, case when o_orderkey % 9 > 0 then o_totalprice end as gen_temperature, cast(0.5 as double) as gen_top_p, cast(o_orderkey as double) as gen_max_tokens, cast(o_orderkey % 4 as double) as trial_k, 'c' || o_orderkey as env_git_commit, case when o_orderkey % 13 > 0 then o_orderkey % 2 = 0 end as env_git_dirty"
YAML = f"""
with l as (select l_orderkey, string_agg('    - type: "' || l_returnflag || '"' || chr(10) || '      value: ' || cast(cast(l_quantity as bigint) as varchar) || chr(10) || '      name: "' || l_returnflag || '"', chr(10) order by {c.LINE_ORDER}) filter (where l_discount > 0) as metrics from lineitem group by 1)
select o_orderkey as version_id, case when metrics is not null then 'model-index:' || chr(10) || '- name: "' || o_orderpriority || '"' || chr(10) || '  results:' || chr(10) || '  - task:' || chr(10) || '      type: "t"' || chr(10) || '      name: "t"' || chr(10) || '    dataset:' || chr(10) || '      type: "t"' || chr(10) || '      name: "t"'
  || case when o_orderkey % 2 = 0 then chr(10) || '      split: "test \\"a\\""' else '' end || chr(10) || '    metrics:' || chr(10) || metrics || chr(10) || '    source:' || chr(10) || '      name: "scorebook card/x@' || o_orderkey || '"' || case when o_orderkey % 3 = 0 then chr(10) || '      url: "https://h/' || o_orderkey || '"' else '' end || chr(10) end as yaml,
  case when metrics is null then 'bad_request' end as code from orders left join l on l_orderkey = o_orderkey
""".strip()
COMPARED = f"""
r as {EVAL_RUNS}, cards as (select v.* from hub_targets v where v.type = 'card' and not v.tombstoned and {SEEN.format('v')} and v.seq = (select max(w.seq) from hub_versions w where w.record_id = v.record_id and not w.tombstoned)),
users as (select distinct e.version_id as eval_version_id, e.record_id as eval_record_id, k.version_id, k.ns, k.name, k.seq, k.content_hash from (select from_version_id, to_version_id, null as address from relations where type = 'core/uses_eval' and to_version_id is not null union all select from_version_id, null, to_external from relations where type = 'core/uses_eval' and to_external is not null) x
  join hub_targets e on e.type = 'eval' and (e.version_id = x.to_version_id or e.address = x.address) join cards k on k.version_id = x.from_version_id),
used as (select distinct x.from_version_id as version_id, t.record_id as eval_record_id, r.run_id, r.content_hash from relations x join hub_targets t on t.version_id = x.to_version_id join r on r.record_id = t.record_id where x.type = 'core/uses_eval' and t.type = 'eval'
  and ((x.from_version_id % 4 = 0 and run_id in ('r1', 'r2')) or (x.from_version_id % 4 = 1 and run_id in ('r1', 'r99')) or (x.from_version_id % 4 >= 2 and not r.archived and not r.tombstoned))),
member as (select *, cast(substr(run_id, 2) as integer) as n from used),
sums as (select version_id, eval_record_id, count(*) as runs_used, bool_and(version_id % 10 > 0 and n % 5 > 0 and n % 2 = version_id % 2) as same_harness, bool_and(version_id % 10 > 0 and n % 3 = version_id % 3) as same_model,
  sha256('[' || string_agg('["' || run_id || '","' || content_hash || '"]', ',' order by run_id) || ']') as used_set_hash, case when version_id % 3 = 0 then string_agg(run_id, ',' order by run_id) else '' end as changed from member group by 1, 2),
compared as (select u.*, case when u.version_id % 10 > 0 then 'harness=' || sha256('h' || (u.version_id % 2)) || ',model=' || sha256('m' || (u.version_id % 3)) end as fingerprints, case when u.version_id % 10 > 0 then sha256('m' || (u.version_id % 3)) end as model_print,
  coalesce(same_harness, false) as same_harness, coalesce(same_model, false) as same_model, coalesce(runs_used, 0) as runs_used, coalesce(used_set_hash, sha256('[]')) as used_set_hash, coalesce(changed, '') as changed from users u left join sums s on s.version_id = u.version_id and s.eval_record_id = u.eval_record_id)
""".strip()
SQL = {
    "proj_generated": f"select {HOT} from orders",
    "proj_ext": "select o_orderkey as version_id, case when o_orderkey % 4 > 0 then cast(o_orderkey % 10 as double) end as rung, case when o_orderkey % 4 = 0 then 'r' end as rung_text, true as flag from orders",
    "proj_run_body": "select doc_id, case when doc_id % 3 > 0 then lang end as model_id, cast(n_chars as double) as temperature, case when doc_id % 2 = 0 then true end as dirty from documents",
    "flt_hot_columns": f"select version_id, task_id from (select {HOT} from orders) where model_id = 'm1' and gen_temperature >= 100000 and not env_git_dirty",
    "flt_body_below": f"select version_id, task_id from (select {HOT} from orders) where model_id = 'm1' and gen_temperature >= 100000 and not env_git_dirty",
    "sink_hf_yaml": YAML,
    "graph_comparison": f"with {COMPARED} select eval_version_id, version_id, ns, name, seq, content_hash, fingerprints, same_harness, same_model, runs_used, used_set_hash, changed from compared",
    "agg_group_by_fp": f"with {COMPARED} select eval_version_id, model_print as fingerprint, string_agg(ns || '/' || name || ' ' || version_id, ',' order by ns, name, version_id) as items from compared group by 1, 2",
}
QUERIES = {name: globals()[name] for name in SQL}
ORACLES = {name: c.sql(text) for name, text in SQL.items()}
