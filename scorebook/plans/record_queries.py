"""Queries over records and versions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, jsonx
from ..operators import filters, paging
from ..operators import records as rec
from ..sources import carriers as c

CALLER = ["BUILDING"]
SEEN = "(r.visibility = 'public' or r.ns in ('BUILDING'))"
LATEST = "v.seq = (select max(w.seq) from versions w where w.record_id = v.record_id and not w.tombstoned)"
BASE = f"records r join versions v on v.record_id = r.record_id where {SEEN} and not v.tombstoned"


def vocabulary(spark: SparkSession, d: str) -> filters.Vocabulary:
    s = filters.Scalar
    results = filters.Side(c.results(spark, d), "version_id", {
        "metric": s(F.col("metric"), "string"), "aggregation": s(F.col("aggregation"), "string"),
        "value": s(F.col("value"), "number"), "n": s(F.col("n"), "number"),
    })
    prints = c.fingerprints(spark, d)
    return filters.Vocabulary(
        scalars={
            "model.id": s(F.col("model_id"), "string"), "generation.temperature": s(F.col("temperature"), "number"),
            "created_at": s(F.col("created_at").cast("timestamp"), "timestamp"), "name": s(F.col("name"), "string", indexed=False),
            "public": s(F.col("visibility") == "public", "boolean"),
        },
        sides={"results": results},
        facts={f"fingerprint.{f}": filters.Fact(prints.where(F.col("facet") == f), "version_id", "fingerprint") for f in ("model", "env")},
    )


def _filtered(where: dict, spark: SparkSession, d: str, every: bool = True) -> DataFrame:
    rows = rec.scan(c.records(spark, d), c.versions(spark, d), CALLER, every)
    return filters.apply(rows, where, vocabulary(spark, d)).select("version_id", "record_id", "seq")


def leaf(path: str, op: str, value=None) -> dict:
    return {"path": path, "op": op} | ({} if op == "exists" else {"value": value})


MODEL_1 = "sha256('1-URGENT')"
HIGH = {"path": "results", "op": "any", "match": {"metric": "R", "value": {"op": "gte", "value": 90000}}}
HIGH_SQL = "exists (select 1 from results x where x.version_id = v.version_id and x.metric = 'R' and x.value >= 90000)"


def _fp(op: str):
    import hashlib

    return {"path": "fingerprint.model", "op": op, "value": hashlib.sha256(b"1-URGENT").hexdigest()}


PRINT = f"exists (select 1 from fingerprints f where f.version_id = v.version_id and f.facet = 'model' and f.fingerprint = {MODEL_1})"
#: name: (filter, its SQL condition), over all live visible versions
FILTERS = {
    "flt_and": ({"and": [leaf("model.id", "eq", "1-URGENT"), leaf("generation.temperature", "lt", 100000)]}, "v.model_id = '1-URGENT' and v.temperature < 100000"),
    "flt_or": ({"or": [leaf("model.id", "eq", "5-LOW"), leaf("generation.temperature", "gte", 300000)]}, "v.model_id = '5-LOW' or v.temperature >= 300000"),
    "flt_empty_or": ({"or": []}, "false"),
    "flt_not": ({"not": leaf("model.id", "in", ["5-LOW", "2-HIGH"])}, "not (v.model_id in ('5-LOW', '2-HIGH'))"),
    "flt_eq": (leaf("model.id", "eq", "3-MEDIUM"), "v.model_id = '3-MEDIUM'"),
    "flt_ne": (leaf("model.id", "ne", "3-MEDIUM"), "v.model_id <> '3-MEDIUM'"),
    "flt_gt": (leaf("generation.temperature", "gt", 250000), "v.temperature > 250000"),
    "flt_gte": (leaf("generation.temperature", "gte", 250000), "v.temperature >= 250000"),
    "flt_lt": (leaf("generation.temperature", "lt", 50000), "v.temperature < 50000"),
    "flt_lte": (leaf("generation.temperature", "lte", 50000), "v.temperature <= 50000"),
    "flt_in": (leaf("model.id", "in", ["1-URGENT", "2-HIGH"]), "v.model_id in ('1-URGENT', '2-HIGH')"),
    "flt_prefix": (leaf("model.id", "prefix", "4-"), "v.model_id like '4-%'"),
    "flt_contains": (leaf("model.id", "contains", "IG"), "v.model_id like '%IG%'"),
    "flt_exists_col": (leaf("model.id", "exists"), "v.model_id is not null"),
    "flt_boolean": (leaf("public", "eq", False), "(r.visibility = 'public') = false"),
    "flt_timestamp": (leaf("created_at", "gte", "1998-01-01T00:00:00Z"), "v.created_at >= timestamp '1998-01-01 00:00:00'"),
    "flt_fp_eq": (_fp("eq"), PRINT),
    "flt_fp_ne": (_fp("ne"), f"not {PRINT}"),
    "flt_fp_exists": ({"path": "fingerprint.env", "op": "exists"}, "exists (select 1 from fingerprints f where f.version_id = v.version_id and f.facet = 'env')"),
    "flt_any_results": (HIGH, HIGH_SQL),
    "join_anti_not_exists": ({"not": HIGH}, f"not {HIGH_SQL}"),
    "join_semi_exists": ({"or": [HIGH, leaf("model.id", "eq", "1-URGENT")]}, f"{HIGH_SQL} or v.model_id = '1-URGENT'"),
    "flt_any_two": ({"and": [HIGH, {"path": "results", "op": "any", "match": {"metric": "A", "aggregation": "F"}}]}, f"{HIGH_SQL} and exists (select 1 from results x where x.version_id = v.version_id and x.metric = 'A' and x.aggregation = 'F')"),
}


def flt_latest(spark, d):
    return rec.latest(c.versions(spark, d)).select("version_id", "record_id", "seq")


def flt_live(spark, d):
    return rec.live(c.versions(spark, d)).select("version_id", "record_id", "seq")


def flt_visibility(spark, d):
    return c.records(spark, d).where(rec.visible(CALLER)).select("record_id", "ns", "visibility")


def flt_search_ci(spark, d):
    return c.records(spark, d).where(F.lower("name").contains("r#00000012")).select("record_id", "name")


def src_record_scan(spark, d):
    return rec.scan(c.records(spark, d), c.versions(spark, d), CALLER).select("version_id", "record_id", "seq", "ns", "name")


def search_best_metric(spark, d):
    keys = [("best", "desc")]
    found = rec.search(c.records(spark, d), c.versions(spark, d), vocabulary(spark, d), leaf("model.id", "ne", "5-LOW"), keys, CALLER, metric=(c.results(spark, d), "R"))
    return found.select("version_id", "record_id", "seq", "best")


def sort_metric_asc(spark, d):
    found = rec.search(c.records(spark, d), c.versions(spark, d), vocabulary(spark, d), None, [("best", "asc")], CALLER, metric=(c.results(spark, d), "A"))
    return found.select("version_id", "best")


def join_lateral_best(spark, d):
    return c.versions(spark, d).select("version_id").join(rec.best_metric(c.results(spark, d), "R", "desc"), "version_id", "left")


def sort_created(spark, d):
    return rec.search(c.records(spark, d), c.versions(spark, d), vocabulary(spark, d), caller=CALLER).select("version_id", "created_at")


def sort_nulls(spark, d):
    rows = c.versions(spark, d).join(rec.best_metric(c.results(spark, d), "R", "desc"), "version_id", "left")
    return paging.page(rows, [("best", "desc"), ("version_id", "desc")], 200).select("version_id", "best")


def sort_multi(spark, d):
    keys = [("model_id", "asc"), ("temperature", "desc"), ("version_id", "desc")]
    return paging.page(c.versions(spark, d), keys, 100).select("version_id", "model_id", "temperature")


def page_keyset_row(spark, d):
    keys = [("temperature", "desc"), ("version_id", "desc")]
    return paging.page(c.versions(spark, d), keys, 50, [200000.0, 500], drop_nulls=True).select("version_id", "temperature")


def page_keyset_lex(spark, d):
    keys = [("model_id", "asc"), ("temperature", "desc"), ("version_id", "desc")]
    return paging.page(c.versions(spark, d), keys, 50, ["2-HIGH", 150000.0, 100], drop_nulls=True).select("version_id", "model_id", "temperature")


def page_list(spark, d):
    return paging.page(c.records(spark, d), [("name", "asc"), ("record_id", "asc")], 50, ["Customer#000000050", 50]).select("record_id", "name")


def page_offset(spark, d):
    return c.registry(spark, d).orderBy("kind", "id").offset(1).limit(2)


def page_audit(spark, d):
    return c.bodies(spark, d).where("version_id < 500").orderBy(F.desc("version_id")).limit(51).select("version_id", "type")


def list_versions(spark, d):
    return c.versions(spark, d).select("record_id", "seq", "version_id", "tombstoned")


def list_records(spark, d):
    made = c.versions(spark, d).groupBy("record_id").agg(F.min("created_at").alias("created_at"))
    rows = c.records(spark, d).where(rec.visible(CALLER)).join(made, "record_id")
    return paging.page(rows, [("created_at", "desc"), ("record_id", "desc")], 50).select("record_id", "created_at")


def get_by_seq(spark, d):
    return rec.by_seq(c.versions(spark, d), 2).select("record_id", "version_id")


def agg_max_seq(spark, d):
    return rec.next_seq(c.versions(spark, d))


def agg_namespace_counts(spark, d):
    return rec.namespace_counts(c.records(spark, d), c.versions(spark, d), CALLER)


def agg_best(spark, d):
    r = c.results(spark, d)
    return rec.best_metric(r, "N", "asc")


def agg_distinct(spark, d):
    return c.results(spark, d).select("version_id", "metric").distinct()


def proj_hit(spark, d):
    rows = rec.scan(c.records(spark, d), c.versions(spark, d), CALLER)
    return rows.select("version_id", "record_id", "ns", "name", "visibility", "seq", "created_at", "model_id", "temperature", "env")


def proj_expand(spark, d):
    page = rec.search(c.records(spark, d), c.versions(spark, d), vocabulary(spark, d), sort=[("temperature", "desc")], caller=CALLER).select("version_id", "temperature")
    prints = c.fingerprints(spark, d).groupBy("version_id").pivot("facet", ["model", "env"]).agg(F.max("fingerprint"))
    return page.join(prints, "version_id", "left").select("version_id", "temperature", F.col("model").alias("model_print"), F.col("env").alias("env_print"))


def join_inner_equi(spark, d):
    return c.records(spark, d).join(c.versions(spark, d), "record_id").groupBy("ns").agg(F.count("*").alias("versions"))


def _json(spark, d):
    return c.bodies(spark, d).withColumn("v", jsonx.parsed(F.col("body")))


def fn_json_num(spark, d):
    return _json(spark, d).select("version_id", jsonx.json_num(F.col("v"), "$.k").alias("k"), jsonx.json_str(F.col("v"), "$.k").alias("text"))


def flt_exists_body(spark, d):
    return _json(spark, d).where(jsonx.exists(F.col("v"), "$.k") & ~jsonx.exists(F.col("v"), "$.missing")).select("version_id")


def flt_body_eq(spark, d):
    return _json(spark, d).where(jsonx.equals(F.col("v"), "$.k", 39)).select("version_id")


def flt_body_contains(spark, d):
    return c.bodies(spark, d).where(jsonx.contains(F.col("body"), {"k": 39.0})).select("version_id")


def fn_concat_addr(spark, d):
    rows = c.records(spark, d).join(c.versions(spark, d), "record_id")
    return rows.select("version_id", ids.address(F.lower("ns"), F.lower(F.regexp_replace("name", "#", "-")), F.col("seq")).alias("address"))


def fn_parse_target(spark, d):
    rows = fn_concat_addr(spark, d).withColumn("t", ids.parsed_target(F.col("address")))
    return rows.select("version_id", "t.kind", "t.ns", "t.name", "t.seq")


def fn_is_id(spark, d):
    name = F.concat(F.lower("c_mktsegment"), F.lit("/"), F.col("c_name"))
    rows = c.table(spark, d, "customer").select("c_custkey", ids.is_id(F.lower(F.regexp_replace(name, "#", "."))).alias("good"), ids.is_id(name).alias("raw"))
    return rows


def fn_rfc3339(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return c.table(spark, d, "events").select("event_id", F.unix_timestamp(ids.instant(text)).alias("instant"), ids.instant(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).isNull().alias("refused"))


def fn_hex(spark, d):
    return c.table(spark, d, "orders").select("o_orderkey", F.lower(F.hex(ids.unhex_strict(F.lower(F.hex("o_orderpriority"))))).alias("h"), ids.unhex_strict(F.col("o_orderpriority")).isNull().alias("refused"))


def fn_sha256(spark, d):
    return c.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


ORDER_BEST = "order by best desc nulls first, version_id desc limit 51"
BEST = "left join lateral (select max(x.value) as best from results x where x.version_id = v.version_id and x.metric = 'R') b on true"
SQL = {
    "flt_latest": f"select version_id, record_id, seq from versions v where not v.tombstoned and {LATEST}",
    "flt_live": "select version_id, record_id, seq from versions where not tombstoned",
    "flt_visibility": f"select record_id, ns, visibility from records r where {SEEN}",
    "flt_search_ci": "select record_id, name from records where name ilike '%r#00000012%'",
    "src_record_scan": f"select v.version_id, v.record_id, v.seq, r.ns, r.name from {BASE} and {LATEST}",
    "search_best_metric": f"select v.version_id, v.record_id, v.seq, b.best from records r join versions v on v.record_id = r.record_id {BEST} where {SEEN} and not v.tombstoned and {LATEST} and v.model_id <> '5-LOW' {ORDER_BEST}",
    "sort_metric_asc": f"select v.version_id, b.best from records r join versions v on v.record_id = r.record_id left join (select version_id, min(value) as best from results where metric = 'A' group by 1) b on b.version_id = v.version_id where {SEEN} and not v.tombstoned and {LATEST} order by best asc nulls last, v.version_id asc limit 51",
    "join_lateral_best": f"select v.version_id, b.best from versions v {BEST}",
    "sort_created": f"select v.version_id, v.created_at from {BASE} and {LATEST} order by v.created_at desc, v.version_id desc limit 51",
    "sort_nulls": f"select v.version_id, b.best from versions v {BEST} order by best desc nulls first, version_id desc limit 201",
    "sort_multi": "select version_id, model_id, temperature from versions order by model_id, temperature desc, version_id desc limit 101",
    "page_keyset_row": "select version_id, temperature from versions where (temperature, version_id) < (200000.0, 500) order by temperature desc, version_id desc limit 51",
    "page_keyset_lex": "select version_id, model_id, temperature from versions where model_id > '2-HIGH' or (model_id = '2-HIGH' and temperature < 150000.0) or (model_id = '2-HIGH' and temperature = 150000.0 and version_id < 100) order by model_id, temperature desc, version_id desc limit 51",
    "page_list": "select record_id, name from records where (name, record_id) > ('Customer#000000050', 50) order by name, record_id limit 51",
    "page_offset": "select kind, id from registry order by kind, id limit 2 offset 1",
    "page_audit": "select version_id, type from bodies where version_id < 500 order by version_id desc limit 51",
    "list_versions": "select record_id, seq, version_id, tombstoned from versions",
    "list_records": f"select r.record_id, min(v.created_at) as created_at from records r join versions v on v.record_id = r.record_id where {SEEN} group by 1 order by 2 desc, 1 desc limit 51",
    "get_by_seq": "select record_id, version_id from versions where seq = 2",
    "agg_max_seq": "select record_id, coalesce(max(seq), 0) + 1 as next_seq from versions group by 1",
    "agg_namespace_counts": f"select r.ns, count(*) as records from records r where {SEEN} and exists (select 1 from versions v where v.record_id = r.record_id and not v.tombstoned) group by 1",
    "agg_best": "select version_id, min(value) as best from results where metric = 'N' group by 1",
    "agg_distinct": "select distinct version_id, metric from results",
    "proj_hit": f"select v.version_id, v.record_id, r.ns, r.name, r.visibility, v.seq, v.created_at, v.model_id, v.temperature, v.env from {BASE} and {LATEST}",
    "proj_expand": f"with p as (select v.version_id, v.temperature from {BASE} and {LATEST} order by v.temperature desc, v.version_id desc limit 51) select p.*, m.fingerprint as model_print, e.fingerprint as env_print from p left join fingerprints m on m.version_id = p.version_id and m.facet = 'model' left join fingerprints e on e.version_id = p.version_id and e.facet = 'env'",
    "join_inner_equi": "select ns, count(*) as versions from records join versions using (record_id) group by 1",
    "fn_json_num": "select version_id, cast(json_extract(body, '$.k') as double) as k, case when json_type(body, '$.k') = 'VARCHAR' then json_extract_string(body, '$.k') end as text from bodies",
    "flt_exists_body": "select version_id from bodies where json_exists(body, '$.k') and not json_exists(body, '$.missing')",
    "flt_body_eq": "select version_id from bodies where json_contains(body, '{\"k\": 39}')",
    "flt_body_contains": "select version_id from bodies where json_contains(body, '{\"k\": 39}')",
    "fn_concat_addr": "select version_id, lower(ns) || '/' || lower(replace(name, '#', '-')) || '@' || seq as address from records join versions using (record_id)",
    "fn_parse_target": "select version_id, 'version' as kind, lower(ns) as ns, lower(replace(name, '#', '-')) as name, cast(seq as bigint) as seq from records join versions using (record_id)",
    "fn_is_id": "select c_custkey, regexp_full_match(lower(replace(c_mktsegment || '/' || c_name, '#', '.')), '[a-z0-9][a-z0-9._-]*/[a-z0-9][a-z0-9._-]*') as good, regexp_full_match(lower(c_mktsegment) || '/' || c_name, '[a-z0-9][a-z0-9._-]*/[a-z0-9][a-z0-9._-]*') as raw from customer",
    "fn_rfc3339": "select event_id, cast(floor(epoch(ts)) as bigint) as instant, true as refused from events",
    "fn_hex": "select o_orderkey, lower(hex(o_orderpriority)) as h, true as refused from orders",
    "fn_sha256": "select doc_id, sha256(text) as digest from documents",
} | {name: f"select v.version_id, v.record_id, v.seq from {BASE} and ({condition})" for name, (_, condition) in FILTERS.items()}

QUERIES = {name: globals()[name] for name in SQL if name not in FILTERS} | {name: partial(_filtered, where) for name, (where, _) in FILTERS.items()}
ORACLES = {name: c.sql(text) for name, text in SQL.items()}
