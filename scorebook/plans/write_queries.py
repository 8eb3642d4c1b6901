"""Queries of writes: runs with inherited facets, used sets at ingest, the registry, labels, badges and objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon
from ..operators import derive, ingest_records, registry_ops, run_writes, used_sets
from ..sources import carriers as c
from ..sources.staged import Staged, keep, shared_folder
from .relation_queries import CALLER, SEEN

# --- runs


def _headers(spark, d):
    text = F.concat(F.lit('{"title":"x","model":{"id":"m-'), F.col("source"), F.lit('"},"task":{"id":"t"},"harness":null}'))
    return _runs(spark, d).select("record_id", text.alias("header")).distinct()


def _runs(spark, d):
    return c.table(spark, d, "documents").withColumn("record_id", F.concat("source", F.lit("-"), (F.col("doc_id") % 8).cast("string"))).withColumn("run_id", F.col("doc_id").cast("string"))


def _batch(rows, chars, status):
    """Bodies that leave the model to the header or, every fifth, say that there is none."""
    model = F.when(F.col("doc_id") % 5 == 0, ',"model":null').otherwise("")
    body = F.concat(F.lit('{"status":"'), status, F.lit('","run_id":"'), F.col("run_id"), F.lit('","metrics":{"core/chars":'), chars.cast("string"), F.lit("}"), model, F.lit("}"))
    return rows.select("record_id", F.col("doc_id").cast("int").alias("position"), "run_id", body.alias("body"))


def fn_materialise(spark, d):
    made = run_writes.prepared(_batch(_runs(spark, d), F.col("n_chars"), F.lit("ok")), _headers(spark, d))
    return made.select("record_id", "run_id", "stored")


def fn_run_hash(spark, d):
    return run_writes.run_hash(_batch(_runs(spark, d), F.col("n_chars"), F.lit("ok")), _headers(spark, d)).select("record_id", "run_id", "content_hash")


def op_put_runs(spark, d):
    """Two batches over tables with archived and deleted runs: the runs after both, what the second did, and what it refused."""
    store = Staged(spark, shared_folder(spark), run_writes.TABLES, "record_id")
    rows, headers, ready = _runs(spark, d), _headers(spark, d), spark.createDataFrame([], "sha256 string")
    run_writes.put_runs(store, _batch(rows.where("doc_id % 2 = 0"), F.col("n_chars"), F.lit("ok")), headers, ready)
    n = F.col("run_id").cast("long")
    held = store.read("runs").withColumn("archived", n % 22 == 0).withColumn("tombstoned", n % 26 == 0)
    store.replace({"runs": store.keep(held)}, list(range(store.buckets)))
    status = F.when(F.col("doc_id") % 97 == 0, "error").otherwise("ok")
    second = _batch(rows.where("doc_id % 3 = 0"), F.col("n_chars") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0), status)
    done, refused = run_writes.put_runs(store, second, headers, ready)
    now = store.read("runs").join(done.select("record_id", "run_id", "change"), ["record_id", "run_id"], "left")
    metrics = store.read("run_metrics").select("record_id", "run_id", F.col("value").cast("long").alias("chars"))
    runs = now.join(metrics, ["record_id", "run_id"], "left").select("record_id", "run_id", "content_hash", "archived", "tombstoned", "change", "chars", F.lit(None).cast("string").alias("error"))
    why = refused.select("record_id", "run_id", F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("boolean").alias("archived"), F.lit(None).cast("boolean").alias("tombstoned"), F.lit("refused").alias("change"), F.lit(None).cast("long").alias("chars"), F.concat("path", F.lit(" "), "code").alias("error"))
    return runs.unionByName(why)


def der_batch_atomic(spark, d):
    """Per record how many elements of a batch fail, and how many are written: all or none."""
    rows = _runs(spark, d)
    made = run_writes.prepared(_batch(rows, F.col("n_chars"), F.when(F.col("doc_id") % 31 == 0, "gone").otherwise("ok")), _headers(spark, d))
    old = made.limit(0).select("record_id", "run_id", "content_hash", F.lit(False).alias("archived"), F.lit(False).alias("tombstoned"))
    refused = run_writes.rejections(made, old, spark.createDataFrame([], "sha256 string"))
    done = run_writes.written(made, refused, old).groupBy("record_id").agg(F.count("*").alias("written"))
    failing = refused.groupBy("record_id").agg(F.countDistinct("position").alias("failing"))
    return rows.select("record_id").distinct().join(failing, "record_id", "left").join(done, "record_id", "left").select("record_id", F.coalesce("failing", F.lit(0)).alias("failing"), F.coalesce("written", F.lit(0)).alias("written"))


# --- used sets


def _uses(spark, d):
    """Edges of all versions with what they resolved to; some name runs, some of them unknown ones."""
    to = c.hub_targets(spark, d).select(F.col("version_id").alias("to_version_id"), "ns", "name", F.when(F.col("type") == "eval", F.col("record_id")).alias("eval_record_id"))
    at = F.col("from_version_id") % 4
    attrs = F.when(at == 0, '{"runs":["r1","r2"]}').when(at == 1, '{"runs":["r1","r99"]}').when(at == 2, '{"note":1}')
    edges = c.relations(spark, d).where("to_version_id is not null").join(to, "to_version_id")
    return edges.select(F.col("from_version_id").alias("version_id"), "ordinal", "type", "ns", "name", "eval_record_id", attrs.alias("attrs"))


def eval_runs(spark, d):
    return c.versions(spark, d).select("record_id", F.concat(F.lit("r"), F.col("seq").cast("string")).alias("run_id"), F.sha2(F.concat(F.lit("run"), F.col("version_id").cast("string")), 256).alias("content_hash"), (F.col("version_id") % 5 == 0).alias("archived"), (F.col("version_id") % 7 == 0).alias("tombstoned"))


def set_union_named_runs(spark, d):
    return used_sets.named_runs(used_sets.uses(_uses(spark, d)))


def op_ingest_card_runs(spark, d):
    """Used sets, judgements and errors of all versions as new cards, by a writer who may not see every eval."""
    edges = keep(_uses(spark, d))
    verdict = edges.where("type = 'core/uses_eval'").select("version_id", "ordinal", F.concat("ns", F.lit("/"), "name").alias("eval"), F.concat(F.lit("r"), (1 + F.col("version_id") % 3).cast("string")).alias("run_id"), F.lit("core/x").alias("metric"), F.col("ordinal").cast("double").alias("value"))
    done = used_sets.fix(edges, verdict.where("version_id % 5 > 0"), eval_runs(spark, d), c.hub_records(spark, d), CALLER)
    text = lambda *cs: F.concat_ws(" ", *[F.col(x).cast("string") for x in cs])
    used = done.used.select(F.lit("used").alias("kind"), "version_id", text("eval_record_id", "run_id", "content_hash").alias("what"))
    rows = done.verdicts.select(F.lit("verdict").alias("kind"), "version_id", text("ordinal", "eval_record_id", "run_id", "metric").alias("what"))
    return used.unionByName(rows).unionByName(done.errors.select(F.lit("error").alias("kind"), "version_id", text("path", "code").alias("what")))


def join_card_lookup(spark, d):
    """Requests for the runs of evals that each name a card per edge of an older or newer version: answered whole or not at all."""
    records, edges = c.hub_records(spark, d), c.relations(spark, d)
    targets = c.hub_targets(spark, d)
    own = targets.select(F.col("version_id").alias("from_version_id"), "ns", "name")
    to = targets.select(F.col("version_id").alias("to_version_id"), F.col("record_id").alias("eval_record_id"))
    named = edges.where("type = 'core/uses_eval' and to_version_id is not null").join(own, "from_version_id").join(to, "to_version_id")
    requests = named.select(F.col("from_version_id").alias("request"), F.col("eval_record_id").alias("position"), "ns", "name", "eval_record_id").distinct()
    found, unknown = used_sets.card_lookup(requests, records, targets.select("version_id", "record_id", "seq", "tombstoned"), edges, CALLER)
    return found.select("request", "position", "version_id", "seq").unionByName(unknown.select("request", "position", F.lit(None).cast("long").alias("version_id"), F.lit(None).cast("long").alias("seq")))


# --- records


def _bodies(spark, d):
    """All versions of all records as bodies; some lack a title, some refer outside or to nothing."""
    body = F.expr(
        """concat('{"schema":"', case when type = 'card' then 'scorebook.card/1.1' else 'scorebook.eval/2.0","origin":"live","eval_kind":"run_set' end, '",', case when version_id % 17 > 0 then concat('"title":"', env, '",') else '' end,
        '"producer":{"version":"1","name":"h"},', case version_id % 8 when 0 then '"relations":[{"type":"core/x","to":"external:x"}],' when 4 then '"relations":[{"type":"core/x","to":"nowhere/none@1"}],' else '' end, '"redaction":{"applied":', model_id = '1-URGENT', '}}')"""
    )
    return c.versions(spark, d).join(c.hub_records(spark, d).select("record_id", "type"), "record_id").withColumn("body", body)


def op_ingest(spark, d):
    """Bodies from each record's third on, in order, for records that have the two before: numbers, changes, badges, refusals."""
    rows = _bodies(spark, d)
    there = rows.where("seq <= 2").withColumn("body", canon.canonical_json(F.col("body"))).select("version_id", "record_id", "seq", "body", "tombstoned")
    batch = rows.where("seq > 2").select(F.col("seq").cast("int").alias("position"), "version_id", "record_id", "body")
    none = spark.createDataFrame([], "kind string, ns string, id string, version string")
    done = ingest_records.create_or_append(batch, c.hub_records(spark, d), there, eval_runs(spark, d), none, spark.createDataFrame([], "sha256 string"), CALLER)
    new = done.versions.select("version_id", "seq", "content_hash", F.array_join("changed", ",").alias("changed"), F.array_join("badges", ",").alias("badges"))
    why = done.errors.groupBy("version_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit(" "), "code"))), ",").alias("errors"))
    return done.outcomes.join(new, "version_id", "left").join(why, "version_id", "left")


# --- lookups


def _labelled(spark, d):
    return c.hub_versions(spark, d).withColumn("label", F.when(F.col("version_id") % 4 == 0, F.concat(F.lit("l"), F.col("seq").cast("string"))))


def _addresses(spark, d):
    forms = F.array(F.col("name"), F.concat("name", F.lit("@2")), F.concat("name", F.lit("@l3")), F.concat("name", F.lit("@l3@x")))
    return c.hub_records(spark, d).select("type", "ns", F.explode(forms).alias("address"))


def get_by_label(spark, d):
    """Versions by name, by name and number, by name and label, as a reader may see them."""
    return registry_ops.lookup(_addresses(spark, d), c.hub_records(spark, d), _labelled(spark, d), CALLER)


def proj_address(spark, d):
    return _addresses(spark, d).withColumn("a", registry_ops.addressed(F.col("address"))).select("type", "ns", "address", "a.kind", "a.name", "a.seq", "a.label")


# --- registry


def _registry(spark, d):
    """Entries of parts: several versions of an id, one namespace read-only."""
    return c.table(spark, d, "part").select(
        F.when(F.col("p_size") % 3 == 0, "metrics").when(F.col("p_size") % 3 == 1, "harnesses").otherwise("ext_schemas").alias("kind"), F.when(F.col("p_partkey") % 4 == 0, "core").otherwise(F.lower("p_type")).alias("ns"),
        F.lower(F.regexp_replace("p_brand", "#", "-")).alias("id"), F.col("p_size").cast("string").alias("version"), F.lit("applied").alias("state"),
    ).distinct()


def _entries(spark, d):
    s = c.table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").cast("int").alias("position"), F.when(F.col("s_nationkey") % 2 == 0, "ext_schemas").otherwise("metrics").alias("kind"), F.when(F.col("s_suppkey") % 5 == 0, "core").otherwise("economy").alias("ns"),
        F.concat(F.lit("brand-"), (F.col("s_nationkey") % 10).cast("string")).alias("id"), (F.col("s_nationkey") % 50).cast("string").alias("version"),
    )


def registry_list(spark, d):
    return registry_ops.listed(_registry(spark, d), "metrics", "economy", 20, 3)


def op_registry_put(spark, d):
    now, refused = registry_ops.put_entries(_registry(spark, d), _entries(spark, d))
    return now.select("kind", "ns", "id", "version", "state", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("code")).unionByName(refused.select("kind", "ns", "id", "version", F.lit(None).cast("string").alias("state"), "position", "code"))


def op_registry_state(spark, d):
    now, _ = registry_ops.put_entries(_registry(spark, d), _entries(spark, d))
    flips = now.where("state = 'applying' and id < 'brand-5'").select("kind", "ns", "id", "version", F.lit("applied").alias("state"))
    return registry_ops.set_state(now, flips).where("kind = 'ext_schemas'")


def op_set_badges(spark, d):
    """Badges of the versions overwritten for those of which some are known; none is a list too."""
    v = c.versions(spark, d).select("version_id", F.array(F.lit("old")).alias("badges"))
    known = c.results(spark, d).where("metric <> 'N'").groupBy("version_id").agg(F.array_sort(F.collect_set("metric")).alias("badges"))
    known = known.withColumn("badges", F.when(F.size("badges") > 1, F.col("badges")).otherwise(F.array().cast("array<string>")))
    return registry_ops.set_badges(v, known).select("version_id", F.array_join("badges", ",").alias("badges"))


# --- objects


def _objects(spark, d):
    o = c.table(spark, d, "orders").where("o_orderkey % 3 > 0")
    return o.select(F.col("o_orderkey").cast("string").alias("sha256"), (F.col("o_orderkey") % 100).alias("size"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("media_type"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending").alias("state"), (F.col("o_orderstatus") == "F").alias("hashed"), F.col("o_orderdate").alias("created_at"))


def op_upload(spark, d):
    """Objects announced again or anew, and those of them that are in the store completed."""
    lines = c.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("size"), F.min("l_shipdate").alias("created_at"), F.max(F.when(F.col("l_returnflag") == "A", "A")).alias("media_type"))
    uploads = lines.select(F.col("l_linenumber").alias("position"), F.col("l_orderkey").cast("string").alias("sha256"), "size", "media_type", "created_at")
    now = registry_ops.announce(_objects(spark, d), uploads)
    stored = lines.where("l_linenumber = 1").select(F.col("l_orderkey").cast("string").alias("sha256"), F.col("size").alias("actual"), F.when(F.col("l_orderkey") % 11 == 0, "other").otherwise(F.col("l_orderkey").cast("string")).alias("digest"))
    done, refused = registry_ops.complete(now, stored, 40)
    return done.join(refused, "sha256", "left").select("sha256", "size", "media_type", "state", "hashed", "code")


def op_gc_run(spark, d):
    """Objects that are left when references of one kind arrive between the two phases of the sweep."""
    objects = c.table(spark, d, "orders").select(F.col("o_orderkey").alias("sha256"), F.col("o_orderdate").alias("created_at"))
    lines = c.table(spark, d, "lineitem")
    refs, run_refs, later = (lines.where(w).select(F.col("l_orderkey").alias("sha256")) for w in ("l_returnflag = 'A'", "l_linestatus = 'F' and l_tax < 0.02", "l_discount > 0.07"))
    marked = derive.unreferenced(objects, "created_at", F.lit("2000-01-01").cast("timestamp"), refs, run_refs)
    return registry_ops.sweep(objects, marked, refs, run_refs, later)


RECORD = "source || '-' || (doc_id % 8)"
STORED = """'{{"metrics":{{"core/chars":' || {n} || '}},"model":' || case when doc_id % 5 = 0 then 'null' else '{{"id":"m-' || source || '"}}' end || ',"run_id":"' || doc_id || '","status":"ok","task":{{"id":"t"}}}}'"""
ONE = STORED.format(n="n_chars")
TWO = STORED.format(n="(n_chars + case when doc_id % 4 = 0 then 1 else 0 end)")
PUT = f"""
with d as (select *, {RECORD} as record_id from documents), bad as (select distinct record_id from d where doc_id % 3 = 0 and (doc_id % 97 = 0 or doc_id % 26 = 0)),
n as (select *, doc_id % 2 = 0 as old, doc_id % 3 = 0 and record_id not in (select record_id from bad) as new from d)
select record_id, cast(doc_id as varchar) as run_id, sha256(case when new then {TWO} else {ONE} end) as content_hash, old and doc_id % 22 = 0 as archived, old and doc_id % 26 = 0 as tombstoned,
  case when not new then null when not old then 'created' when doc_id % 4 = 0 then 'updated' else 'unchanged' end as change, n_chars + case when new and doc_id % 4 = 0 then 1 else 0 end as chars, cast(null as varchar) as error from n where old or new
union all select record_id, cast(doc_id as varchar), null, null, null, 'refused', null, '/error run_status_detail' from d where doc_id % 3 = 0 and doc_id % 97 = 0
union all select record_id, cast(doc_id as varchar), null, null, null, 'refused', null, '/run_id run_deleted' from d where doc_id % 3 = 0 and doc_id % 26 = 0
""".strip()
EVAL_RUNS = "(select record_id, 'r' || seq as run_id, sha256('run' || version_id) as content_hash, version_id % 5 = 0 as archived, version_id % 7 = 0 as tombstoned from versions)"
USES = f"(select x.from_version_id as version_id, x.ordinal, t.record_id as eval_record_id, t.ns || '/' || t.name as eval, x.from_version_id % 4 as m from relations x join hub_targets t on t.version_id = x.to_version_id where x.type = 'core/uses_eval' and t.type = 'eval' and {SEEN.format('t')})"
CARD_RUNS = f"""
with u as {USES}, r as {EVAL_RUNS}, used as (select distinct u.version_id, u.eval_record_id, r.run_id, r.content_hash from u join r on r.record_id = u.eval_record_id where (m = 0 and run_id in ('r1', 'r2')) or (m = 1 and run_id in ('r1', 'r99')) or (m >= 2 and not archived and not tombstoned)),
verdict as (select x.from_version_id as version_id, x.ordinal, t.ns || '/' || t.name as eval, 'r' || (1 + x.from_version_id % 3) as run_id from relations x join hub_targets t on t.version_id = x.to_version_id where x.type = 'core/uses_eval' and x.from_version_id % 5 > 0),
judged as (select v.*, l.eval_record_id from verdict v left join (select version_id, eval, arg_max(eval_record_id, ordinal) as eval_record_id from u group by 1, 2) l on l.version_id = v.version_id and l.eval = v.eval),
error as (
select u.version_id, '/relations/' || u.ordinal || '/attrs/runs/' || k.k || ' run_unknown' as what from u, (values (0, 0, 'r1'), (0, 1, 'r2'), (1, 0, 'r1'), (1, 1, 'r99')) k(m, k, run_id) where k.m = u.m and not exists (select 1 from r where r.record_id = u.eval_record_id and r.run_id = k.run_id)
union all select j.version_id, '/run_results/' || j.ordinal || '/run_id ' || case when exists (select 1 from r where r.record_id = j.eval_record_id and r.run_id = j.run_id) then 'run_not_in_used_set' else 'run_unknown' end from judged j
where not exists (select 1 from used s where s.version_id = j.version_id and s.eval_record_id = j.eval_record_id and s.run_id = j.run_id))
select 'error' as kind, version_id, what from error
union all select 'used', version_id, eval_record_id || ' ' || run_id || ' ' || content_hash from used where version_id not in (select version_id from error)
union all select 'verdict', version_id, ordinal || ' ' || eval_record_id || ' ' || run_id || ' core/x' from judged where eval_record_id is not null and version_id not in (select version_id from error)
""".strip()
LOOKUP = f"""
with q as (select distinct x.from_version_id as request, e.record_id as eval_record_id, o.type, o.ns, o.name from relations x join hub_targets o on o.version_id = x.from_version_id join hub_targets e on e.version_id = x.to_version_id where x.type = 'core/uses_eval'),
k as (select q.*, v.version_id, v.seq from q left join hub_records r on r.type = 'card' and r.ns = q.ns and r.name = q.name and {SEEN.format('r')}
  left join hub_targets v on v.record_id = r.record_id and not v.tombstoned and v.seq = (select max(w.seq) from hub_versions w where w.record_id = r.record_id and not w.tombstoned)
    and exists (select 1 from relations y join hub_versions t on t.version_id = y.to_version_id where y.from_version_id = v.version_id and y.type = 'core/uses_eval' and t.record_id = q.eval_record_id))
select request, eval_record_id as position, version_id, seq from k where version_id is null or request not in (select request from k where version_id is null)
""".strip()
WRITTEN = """
with b as (select v.*, r.type, case when v.model_id = '1-URGENT' then 'true' else 'false' end as red, case v.version_id % 8 when 0 then '[{"to":"external:x","type":"core/x"}]' when 4 then '[{"to":"nowhere/none@1","type":"core/x"}]' end as rel from versions v join hub_records r on r.record_id = v.record_id),
t as (select *, '{' || case when type = 'eval' then '"eval_kind":"run_set","origin":"live",' else '' end || '"producer":{"name":"h","version":"1"},"redaction":{"applied":' || red || '},' || case when rel is not null then '"relations":' || rel || ',' else '' end || '"schema":"scorebook.' || case when type = 'card' then 'card/1.1' else 'eval/2.0' end || '"' || case when version_id % 17 > 0 then ',"title":"' || env || '"' else '' end || '}' as body from b),
base as (select record_id, 0 as position, cast(null as bigint) as version_id, arg_max(body, seq) as body, arg_max(red, seq) as red, arg_max(coalesce(rel, ''), seq) as rel, arg_max(case when version_id % 17 > 0 then env else '' end, seq) as env, any_value(type) as type from t where seq <= 2 and not tombstoned group by 1),
u as (select record_id, position, version_id, body, red, rel, env, type from base union all select record_id, seq, version_id, body, red, coalesce(rel, ''), env, type from t where seq > 2 and version_id % 17 > 0),
p as (select *, lag(body) over w as pb, lag(red) over w as pr, lag(rel) over w as pl, lag(env) over w as pe from u window w as (partition by record_id order by position)),
k as (select *, (select max(x.seq) from versions x where x.record_id = p.record_id and x.seq <= 2) + row_number() over (partition by record_id order by position) as seq from p where version_id is not null and (pb is null or pb <> body))
select version_id, 'appended' as outcome, seq, sha256(body) as content_hash,
  case when pb is null then case when type = 'eval' then 'eval_kind,origin,' else '' end || 'producer,redaction,' || case when rel <> '' then 'relations,' else '' end || 'schema,title' else concat_ws(',', case when red <> pr then 'redaction' end, case when rel <> pl then 'relations' end, case when env <> pe then 'title' end) end as changed,
  concat_ws(',', case when rel not like '%nowhere%' then 'refs_resolved' end, 'metric_registered', case when red = 'true' then 'redacted' end) as badges, cast(null as varchar) as errors from k
union all select version_id, 'unchanged', null, null, null, null, null from p where version_id is not null and pb = body
union all select version_id, 'refused', null, null, null, null, ' schema' from t where seq > 2 and version_id % 17 = 0
""".strip()
ADDRESSES = "(select r.type, r.ns, r.name, r.record_id, r.visibility, r.name || f.form as address, f.form from hub_records r, (values (''), ('@2'), ('@l3'), ('@l3@x')) f(form))"
LABELLED = "(select *, case when version_id % 4 = 0 then 'l' || seq end as label from hub_versions)"
REGISTRY = "(select distinct case p_size % 3 when 0 then 'metrics' when 1 then 'harnesses' else 'ext_schemas' end as kind, case when p_partkey % 4 = 0 then 'core' else lower(p_type) end as ns, lower(replace(p_brand, '#', '-')) as id, cast(p_size as varchar) as version from part)"
ENTRIES = "(select s_suppkey as position, case when s_nationkey % 2 = 0 then 'ext_schemas' else 'metrics' end as kind, case when s_suppkey % 5 = 0 then 'core' else 'economy' end as ns, 'brand-' || (s_nationkey % 10) as id, cast(s_nationkey % 50 as varchar) as version from supplier)"
PUT_ENTRIES = f"with g as {REGISTRY}, e as {ENTRIES}, n as (select *, ns <> 'core' and not exists (select 1 from g where g.kind = e.kind and g.ns = e.ns and g.id = e.id and g.version = e.version) and row_number() over (partition by kind, ns, id, version order by position) = 1 as fresh from e), now as (select *, 'applied' as state from g union all select kind, ns, id, version, case when kind = 'ext_schemas' then 'applying' else 'applied' end from n where fresh)"
MARKED = "o_orderdate < timestamp '2000-01-01' and not exists (select 1 from lineitem where l_orderkey = o_orderkey and (l_returnflag = 'A' or (l_linestatus = 'F' and l_tax < 0.02)))"
UPLOADED = """
with l as (select l_orderkey, l_linenumber, cast(max(l_quantity) as bigint) as size, max(case when l_returnflag = 'A' then 'A' end) as media_type from lineitem group by 1, 2),
a as (select l_orderkey, arg_max(size, l_linenumber) as size, arg_max(media_type, l_linenumber) filter (where media_type is not null) as media_type from l group by 1),
o as (select *, o_orderstatus = 'F' as ready from orders where o_orderkey % 3 > 0),
b as (select coalesce(o_orderkey, l_orderkey) as k, case when coalesce(ready, false) then o_orderkey % 100 else coalesce(a.size, o_orderkey % 100) end as size, case when coalesce(ready, false) then case when o_orderkey % 2 = 0 then o_orderpriority end else coalesce(a.media_type, case when o_orderkey % 2 = 0 then o_orderpriority end) end as media_type, coalesce(ready, false) as ready from o full outer join a on o_orderkey = l_orderkey),
s as (select l_orderkey, size as actual, l_orderkey % 11 = 0 as other from l where l_linenumber = 1),
j as (select b.*, s.actual, case when s.l_orderkey is null then null when actual <> size then 'object_size_mismatch' when actual <= 40 and other then 'object_hash_mismatch' end as code from b left join s on s.l_orderkey = b.k)
select cast(k as varchar) as sha256, size, media_type, case when ready or (actual is not null and code is null) then 'ready' else 'pending' end as state, case when actual is not null and code is null then actual <= 40 else ready end as hashed, code from j
""".strip()
SQL = {
    "fn_materialise": f"select {RECORD} as record_id, cast(doc_id as varchar) as run_id, {ONE} as stored from documents",
    "fn_run_hash": f"select {RECORD} as record_id, cast(doc_id as varchar) as run_id, sha256({ONE}) as content_hash from documents",
    "op_put_runs": PUT,
    "op_ingest": WRITTEN,
    "der_batch_atomic": f"select {RECORD} as record_id, count(*) filter (where doc_id % 31 = 0) as failing, case when count(*) filter (where doc_id % 31 = 0) = 0 then count(*) else 0 end as written from documents group by 1",
    "set_union_named_runs": "select distinct x.from_version_id as version_id, t.record_id as eval_record_id, k.run_id from relations x join hub_targets t on t.version_id = x.to_version_id, (values (0, 'r1'), (0, 'r2'), (1, 'r1'), (1, 'r99')) k(m, run_id) where k.m = x.from_version_id % 4 and x.type = 'core/uses_eval' and t.type = 'eval'",
    "op_ingest_card_runs": CARD_RUNS,
    "join_card_lookup": LOOKUP,
    "get_by_label": f"select a.type, a.ns, a.address, v.version_id, v.seq, v.tombstoned from {ADDRESSES} a join {LABELLED} v on v.record_id = a.record_id and case a.form when '@2' then v.seq = 2 when '@l3' then v.label = 'l3' when '' then not v.tombstoned and v.seq = (select max(w.seq) from hub_versions w where w.record_id = a.record_id and not w.tombstoned) else false end where {SEEN.format('a')}",
    "proj_address": f"select type, ns, address, case form when '' then 'latest' when '@2' then 'seq' else 'label' end as kind, name, case form when '@2' then 2 end as seq, case form when '@l3' then 'l3' when '@l3@x' then 'l3@x' end as label from {ADDRESSES}",
    "registry_list": f"select kind, ns, id, version, 'applied' as state from {REGISTRY} where kind = 'metrics' and ns = 'economy' order by kind, ns, id, version limit 20 offset 3",
    "op_registry_put": f"{PUT_ENTRIES} select kind, ns, id, version, state, cast(null as integer) as position, cast(null as varchar) as code from now union all select kind, ns, id, version, null, position, case when ns = 'core' then 'core_read_only' else 'registry_entry_exists' end from n where not fresh",
    "op_registry_state": f"{PUT_ENTRIES} select kind, ns, id, version, case when state = 'applying' and id < 'brand-5' then 'applied' else state end as state from now where kind = 'ext_schemas'",
    "op_set_badges": "select v.version_id, case when k.n is null then 'old' when k.n > 1 then 'A,R' else '' end as badges from versions v left join (select version_id, count(distinct metric) as n from results where metric <> 'N' group by 1) k on k.version_id = v.version_id",
    "op_upload": UPLOADED,
    "op_gc_run": f"select o_orderkey as sha256, o_orderdate as created_at from orders where not ({MARKED}) or exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount > 0.07)",
}
QUERIES = {name: globals()[name] for name in SQL}
ORACLES = {name: c.sql(text) for name, text in SQL.items()}
