"""Queries of state changes, scopes, references of objects and edges added later."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state_ops as st
from ..sources import carriers as c
from .relation_queries import CALLER, SEEN
from .write_queries import EVAL_RUNS, eval_runs


def _told(done: st.Changed, key: str, what):
    """Rows after the batch, refusals and audit rows as one table: kind, id, what."""
    rows = done.rows.select(F.lit("row").alias("kind"), F.col(key).cast("string").alias("id"), what.alias("what"))
    refused = done.refused.select(F.lit("refused").alias("kind"), F.col("position").cast("string").alias("id"), F.col("code").alias("what"))
    audit = done.audit.select(F.lit("audit").alias("kind"), F.col("position").cast("string").alias("id"), F.concat_ws(" ", "action", "subject", "detail").alias("what"))
    return rows.unionByName(refused).unionByName(audit)


def _events(spark, d):
    return c.table(spark, d, "events").select(F.col("event_id").alias("position"), F.col("user_id").alias("record_id"), "event_type")


def der_label_move(spark, d):
    """A batch of labels, some of digits alone, some for versions that are not there."""
    label = F.when(F.col("version_id") % 4 == 0, "best").when(F.col("version_id") % 4 == 1, F.concat(F.lit("l"), F.col("seq").cast("string")))
    versions = c.hub_versions(spark, d).select("version_id", "record_id", "seq").withColumn("label", label)
    at = F.col("position") % 5
    asked = F.when(at == 0, "best").when(at == 1, "l2").when(at == 2, "7").when(at == 3, "base")
    requests = _events(spark, d).select("position", "record_id", (1 + F.col("position") % 7).alias("seq"), asked.alias("label"))
    return _told(st.move_labels(versions, requests), "version_id", F.col("label"))


def der_visibility(spark, d):
    kind = F.when(F.col("event_type") == "view", "private").when(F.col("event_type") == "click", "public").otherwise("hidden")
    requests = _events(spark, d).select("position", "record_id", kind.alias("visibility"))
    return _told(st.set_visibility(c.hub_records(spark, d), requests), "record_id", F.col("visibility"))


def der_tombstone(spark, d):
    """Versions tombstoned in a batch, repeats and unknown ones refused; and the references of attachments that are left."""
    none = F.lit(None).cast("string")
    versions = c.hub_versions(spark, d).withColumn("body", F.when(~F.col("tombstoned"), F.lit("{}"))).withColumn("reason", none).withColumn("note", none)
    requests = _events(spark, d).where("event_type = 'error' or position % 10 = 0").select("position", "record_id", (1 + F.col("position") % 7).alias("seq"), F.lit("withdrawn").alias("reason"), F.when(F.col("position") % 2 == 0, F.col("event_type")).alias("note"))
    done, left = st.tombstone_versions(versions, requests, c.attachment_refs(spark, d))
    kept = left.groupBy("version_id").agg(F.count("*").alias("n")).select(F.lit("refs").alias("kind"), F.col("version_id").cast("string").alias("id"), F.col("n").cast("string").alias("what"))
    return _told(done, "version_id", F.concat_ws(" ", F.col("tombstoned").cast("string"), "body", "reason", "note")).unionByName(kept)


ACTIONS = ("archive archive unarchive", "archive delete unarchive", "delete delete", "unarchive", "archive")


def der_archive(spark, d):
    """Three requests at most for each run, one after the other; one record has no live version."""
    none = F.lit(None).cast("string")
    runs = c.runs(spark, d).select("record_id", "run_id", "content_hash", "archived", "tombstoned", F.when(~F.col("tombstoned"), F.lit("{}")).alias("body"), none.alias("reason"), none.alias("note"), "doc_id")
    actions = F.split(F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("doc_id") % 5 + 1).cast("int")), " ")
    run = F.when(F.col("doc_id") % 19 == 0, F.concat(F.lit("x"), "run_id")).otherwise(F.col("run_id"))
    requests = runs.select("record_id", run.alias("run_id"), "doc_id", F.posexplode(actions).alias("k", "action"))
    requests = requests.select((F.col("doc_id") * 4 + F.col("k")).alias("position"), "record_id", "run_id", "action", F.when(F.col("action") == "delete", F.lit("error")).alias("reason"), none.alias("note"))
    versions = runs.select("record_id", (F.col("record_id") == "src3").alias("tombstoned")).distinct()
    refs = runs.select("record_id", "run_id", F.col("content_hash").alias("sha256"))
    done, left = st.change_runs(runs, requests, versions, refs)
    kept = left.select(F.lit("refs").alias("kind"), F.col("run_id").alias("id"), F.lit("1").alias("what"))
    return _told(done, "run_id", F.concat_ws(" ", F.col("archived").cast("string"), F.col("tombstoned").cast("string"), "body", "reason")).unionByName(kept)


def _scopes(spark, d):
    scope = lambda n: F.when(n % 3 == 0, "read").when(n % 3 == 1, "write").otherwise("admin")
    key = F.col("c_custkey")
    tokens = c.table(spark, d, "customer").select(key.alias("token_id"), (key % 50).alias("user_id"), F.concat(F.lit("n"), (key % 50).cast("string")).alias("login"), scope(key).alias("scope"))
    covered = c.table(spark, d, "orders").select(F.col("o_custkey").alias("token_id"), F.concat(F.lit("n"), (F.col("o_orderkey") % 60).cast("string")).alias("ns"))
    s = F.col("s_suppkey")
    members = c.table(spark, d, "supplier").select((s % 50).alias("user_id"), F.concat(F.lit("n"), (F.col("s_nationkey") + s % 30).cast("string")).alias("ns"), scope(s).alias("role"))
    return st.effective_scopes(tokens, covered, members)


def der_scope(spark, d):
    return _scopes(spark, d)


def der_scope_permits(spark, d):
    """Whether each order's token may write, or administer every fifth."""
    o = c.table(spark, d, "orders")
    asked = o.select("o_orderkey", F.col("o_custkey").alias("token_id"), F.concat(F.lit("n"), (F.col("o_orderkey") % 61).cast("string")).alias("ns"), F.when(F.col("o_orderkey") % 5 == 0, "admin").otherwise("write").alias("needs"))
    return st.permitted(asked, _scopes(spark, d)).select("o_orderkey", "allowed")


def dsl_metric_gate(spark, d):
    """Searches that sort by metrics of which some are registered in several versions, some in none, and some are no metric."""
    line = c.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    metric = F.when(F.col("l_suppkey") % 7 == 0, "plain").otherwise(F.concat(F.lit("core/m"), (F.col("l_suppkey") % 10).cast("string")))
    registry = c.table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "metrics").otherwise("harnesses").alias("kind"), F.lit("core").alias("ns"), F.concat(F.lit("m"), (F.col("p_size") % 8).cast("string")).alias("id"), F.col("p_partkey").cast("string").alias("version"))
    return st.metric_gate(line.select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("place"), metric.alias("metric")), registry)


def _references(spark, d):
    versions = c.hub_versions(spark, d)
    sha = F.sha2((F.col("version_id") % 700).cast("string"), 256)
    run_refs = versions.where("version_id % 3 = 0").select("record_id", F.concat(F.lit("r"), F.col("seq").cast("string")).alias("run_id"), sha.alias("sha256"))
    refs = c.attachment_refs(spark, d).where("path = 'logs/1.txt'")
    # of records that number in sevens every version counts as tombstoned: their runs are not readable
    dead = versions.withColumn("tombstoned", F.col("tombstoned") | (F.col("record_id") % 7 == 0))
    return st.referencing(refs, run_refs, dead, eval_runs(spark, d), c.hub_records(spark, d))


def join_mutual_refs(spark, d):
    return _references(spark, d)


def _downloads(spark, d, caller):
    n = F.col("p_partkey")
    objects = c.table(spark, d, "part").where("p_partkey <= 900").select(F.sha2(n.cast("string"), 256).alias("sha256"), F.when(n % 4 == 0, "pending").otherwise("ready").alias("state"))
    return st.may_download(objects, _references(spark, d), caller).select("sha256")


def der_download_rule(spark, d):
    return _downloads(spark, d, CALLER)


def der_download_anyone(spark, d):
    return _downloads(spark, d, None)


def op_relation_add(spark, d):
    """An edge added to each version, some naming runs; to cards' used sets as they were written from a part of the edges."""
    attrs = lambda at: F.when(at == 0, '{"runs":["r1","r2"]}').when(at == 1, '{"runs":["r1","r99"]}').when(at == 2, '{"note":1}')
    targets = c.hub_targets(spark, d)
    v = F.col("version_id")
    address = targets.select((v - 1).alias("from_version_id"), F.col("address").alias("to"))
    orders = c.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 23 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("from_version_id"), F.col("o_orderkey").alias("position"))
    requests = orders.join(address, "from_version_id", "left").select("position", "from_version_id", F.when(F.col("position") % 9 == 0, "core/compares").otherwise("core/uses_eval").alias("type"), F.coalesce("to", F.lit("external:x")).alias("to"), attrs(F.col("position") % 4).alias("attrs"))
    old = targets.select((v + 1).alias("to_version_id"), "type").where("type = 'card'")  # edges that are there: every card's version uses the one before
    old = old.select((F.col("to_version_id") - 1).alias("from_version_id"), F.lit("core/uses_eval").alias("type"), F.col("to_version_id"), attrs((F.col("to_version_id") % 3) * 2).alias("attrs"))
    held = eval_runs(spark, d).where("run_id = 'r1'").join(targets.where("type = 'eval'").select("record_id", (v - 1).alias("card")), "record_id")
    used = held.select(F.col("card").alias("version_id"), F.col("record_id").alias("eval_record_id"), "run_id", F.lit("then").alias("content_hash"))
    done = st.add_relations(requests, old, targets, used, eval_runs(spark, d), c.hub_records(spark, d), CALLER)
    edges = done.edges.select(F.lit("edge").alias("kind"), F.col("position").alias("id"), F.concat_ws(" ", "type", F.col("to_version_id").cast("string"), "to_external").alias("what"))
    more = done.used.select(F.lit("used").alias("kind"), F.col("version_id").alias("id"), F.concat_ws(" ", F.col("eval_record_id").cast("string"), "run_id", "content_hash").alias("what"))
    return edges.unionByName(more).unionByName(done.errors.select(F.lit("error").alias("kind"), F.col("position").alias("id"), F.concat_ws(" ", "path", "code").alias("what")))


LABELS = """
with v as (select version_id, record_id, seq, case version_id % 4 when 0 then 'best' when 1 then 'l' || seq end as label from hub_versions),
q as (select event_id as position, user_id as record_id, 1 + event_id % 7 as seq, case event_id % 5 when 0 then 'best' when 1 then 'l2' when 2 then '7' when 3 then 'base' end as label from events),
k as (select q.*, v.version_id, case when q.label is null or q.label = '7' then 'label_invalid' when v.version_id is null then 'version_not_found' end as code from q left join v on v.record_id = q.record_id and v.seq = q.seq),
g as (select * from k where code is null),
e as (select *, max(position) over (partition by record_id, label) as last_of_label, max(position) over (partition by version_id) as last_of_version from g)
select 'row' as kind, cast(v.version_id as varchar) as id, case when v.version_id in (select version_id from g) then (select label from e where e.version_id = v.version_id and position = last_of_version and position = last_of_label)
  when not exists (select 1 from g where g.record_id = v.record_id and g.label = v.label) then v.label end as what from v
union all select 'refused', cast(position as varchar), code from k where code is not null
union all select 'audit', cast(position as varchar), 'label.set ' || record_id || '@' || seq || ' {"label":"' || label || '"}' from g
""".strip()
VISIBILITY = """
with q as (select event_id as position, user_id as record_id, case event_type when 'view' then 'private' when 'click' then 'public' else 'hidden' end as visibility from events),
k as (select q.*, case when r.record_id is null then 'record_not_found' when q.visibility = 'hidden' then 'bad_request' end as code from q left join hub_records r on r.record_id = q.record_id)
select 'row' as kind, cast(r.record_id as varchar) as id, coalesce((select arg_max(k.visibility, k.position) from k where k.code is null and k.record_id = r.record_id), r.visibility) as what from hub_records r
union all select 'refused', cast(position as varchar), code from k where code is not null
union all select 'audit', cast(position as varchar), 'settings.visibility ' || record_id || ' {"visibility":"' || visibility || '"}' from k where code is null
""".strip()
TOMBSTONES = """
with q as (select event_id as position, user_id as record_id, 1 + event_id % 7 as seq, case when event_id % 2 = 0 then event_type end as note from events where event_type = 'error' or event_id % 10 = 0),
k as (select q.*, v.version_id, case when v.version_id is null then 'version_not_found' when v.tombstoned or row_number() over (partition by v.version_id order by position) > 1 then 'already_tombstoned' end as code from q left join hub_versions v on v.record_id = q.record_id and v.seq = q.seq)
select 'row' as kind, cast(v.version_id as varchar) as id, case when k.position is not null then concat_ws(' ', 'true', 'withdrawn', k.note) when v.tombstoned then 'true' else 'false {}' end as what from hub_versions v left join k on k.version_id = v.version_id and k.code is null
union all select 'refused', cast(position as varchar), code from k where code is not null
union all select 'audit', cast(position as varchar), 'version.tombstone ' || record_id || '@' || seq || ' {"version_id":' || version_id || ',"reason":"withdrawn"' || case when note is not null then ',"note":"' || note || '"' else '' end || '}' from k where code is null
union all select 'refs', cast(version_id as varchar), cast(count(*) as varchar) from attachment_refs where version_id not in (select version_id from k where code is null) group by 2
""".strip()
ARCHIVED = """
with q as (select r.*, case when doc_id % 19 = 0 then 'x' else '' end || run_id as asked, unnest(case doc_id % 5 when 0 then ['archive', 'archive', 'unarchive'] when 1 then ['archive', 'delete', 'unarchive'] when 2 then ['delete', 'delete'] when 3 then ['unarchive'] else ['archive'] end) as action, unnest(case doc_id % 5 when 0 then [0, 1, 2] when 1 then [0, 1, 2] when 2 then [0, 1] else [0] end) as k from runs r),
p as (select *, doc_id * 4 + k as position, case when record_id = 'src3' then 'record_not_found' when doc_id % 19 = 0 then 'run_not_found' when tombstoned or (doc_id % 5 = 1 and k = 2) or (doc_id % 5 = 2 and k = 1) then 'run_deleted' end as code,
  k > 0 or archived as was from q),
done as (select * from p where code is null and (action = 'delete' or was <> (action = 'archive')))
select 'row' as kind, r.run_id as id, concat_ws(' ', case when r.tombstoned or record_id = 'src3' or doc_id % 19 = 0 then r.archived when doc_id % 5 in (1, 4) then true when doc_id % 5 in (0, 3) then false else r.archived end,
  r.tombstoned or exists (select 1 from done where done.run_id = r.run_id and action = 'delete'), case when not r.tombstoned and not exists (select 1 from done where done.run_id = r.run_id and action = 'delete') then '{}' end, case when exists (select 1 from done where done.run_id = r.run_id and action = 'delete') then 'error' end) as what from runs r
union all select 'refused', cast(position as varchar), code from p where code is not null
union all select 'audit', cast(position as varchar), 'run.' || action || ' ' || record_id || '/runs/' || run_id || ' {"content_hash":"' || content_hash || '"' || case when action = 'delete' then ',"reason":"error"' else '' end || '}' from done
union all select 'refs', run_id, '1' from runs r where not exists (select 1 from done where done.run_id = r.run_id and action = 'delete')
""".strip()
RANK = "case {0} % 3 when 0 then 0 when 1 then 1 else 2 end"
SCOPES = f"""
select distinct t.c_custkey as token_id, 'n' || (o.o_orderkey % 60) as ns, case when o.o_orderkey % 60 = t.c_custkey % 50 then {RANK.format("t.c_custkey")} else least({RANK.format("t.c_custkey")}, m.role) end as rank
from customer t join orders o on o.o_custkey = t.c_custkey left join (select s_suppkey % 50 as user_id, s_nationkey + s_suppkey % 30 as ns, max({RANK.format("s_suppkey")}) as role from supplier group by 1, 2) m on m.user_id = t.c_custkey % 50 and m.ns = o.o_orderkey % 60
where o.o_orderkey % 60 = t.c_custkey % 50 or m.role is not null
""".strip()
REFERENCES = """
select sha256, r.ns, r.visibility, v.version_id, cast(null as bigint) as record_id, cast(null as varchar) as run_id, false as archived from attachment_refs a join hub_versions v on v.version_id = a.version_id join hub_records r on r.record_id = v.record_id where a.path = 'logs/1.txt'
union all select sha256(cast(v.version_id % 700 as varchar)), r.ns, r.visibility, null, v.record_id, 'r' || v.seq, v.version_id % 5 = 0 from hub_versions v join hub_records r on r.record_id = v.record_id where v.version_id % 3 = 0 and v.record_id % 7 <> 0 and exists (select 1 from hub_versions w where w.record_id = v.record_id and not w.tombstoned)
""".strip()
DOWNLOADS = "with f as ({0}) select sha256(cast(p_partkey as varchar)) as sha256 from part where p_partkey <= 900 and p_partkey % 4 <> 0 and (exists (select 1 from f where f.sha256 = sha256(cast(p_partkey as varchar)) and ({1}(f.visibility = 'public' and not f.archived))){2})"
NAMED = "(values (0, 0, 'r1'), (0, 1, 'r2'), (1, 0, 'r1'), (1, 1, 'r99'))"
ADDED = f"""
with r as {EVAL_RUNS},
q as (select o_orderkey as position, case when o_orderkey % 23 = 0 then -o_orderkey else o_orderkey end as f, case when o_orderkey % 9 = 0 then 'core/compares' else 'core/uses_eval' end as type, o_orderkey % 4 as m from orders),
p as (select q.position, q.type, q.f, q.m, any_value(o.type) as own, coalesce(any_value(t.address), 'external:x') as address, count(x.version_id) as n, min(x.version_id) as t_id, min(x.type) as t_type, min(x.record_id) as t_record
  from q left join hub_targets o on o.version_id = q.f left join hub_targets t on t.version_id = q.f + 1 left join hub_targets x on x.address = t.address and ({SEEN.format('x')} or x.ns = o.ns) group by 1, 2, 3, 4),
s as (select *, n = 1 as ok, coalesce(n = 1 and type = 'core/uses_eval' and own = 'card' and t_type = 'eval', false) as uses from p where own is not null),
bad as (select s.position, '/attrs/runs/' || k.k || ' run_unknown' as what from s, {NAMED} k(m, k, run_id) where s.uses and k.m = s.m and not exists (select 1 from r where r.record_id = s.t_record and r.run_id = k.run_id)),
g as (select s.*, (s.f + 1) % 3 = 0 and v.record_id = s.t_record as old, v.record_id = s.t_record as same from s left join hub_versions v on v.version_id = s.f + 1 where uses and position not in (select position from bad)),
u as (select g.f as version_id, t_record as eval_record_id, r.run_id, r.content_hash, g.same from g join r on r.record_id = g.t_record
  where (g.m < 2 and exists (select 1 from {NAMED} k(m, k, run_id) where k.m = g.m and k.run_id = r.run_id)) or (g.old and r.run_id in ('r1', 'r2')) or (g.m >= 2 and not g.old and not r.archived and not r.tombstoned))
select 'edge' as kind, position as id, type || ' ' || case when ok then cast(t_id as varchar) else address end as what from s where position not in (select position from bad)
union all select 'error', position, what from bad
union all select 'error', position, '/from source_version_unknown' from p where own is null
union all select distinct 'used', version_id, eval_record_id || ' ' || run_id || ' ' || content_hash from u where not same or run_id <> 'r1'
""".strip()
SQL = {
    "der_label_move": LABELS,
    "der_visibility": VISIBILITY,
    "der_tombstone": TOMBSTONES,
    "der_archive": ARCHIVED,
    "der_scope": f"select token_id, ns, case rank when 0 then 'read' when 1 then 'write' else 'admin' end as scope from ({SCOPES})",
    "der_scope_permits": f"select o.o_orderkey, coalesce(s.rank >= case when o.o_orderkey % 5 = 0 then 2 else 1 end, false) as allowed from orders o left join ({SCOPES}) s on s.token_id = o.o_custkey and s.ns = 'n' || (o.o_orderkey % 61)",
    "dsl_metric_gate": "select distinct l_orderkey as request, '/sort/' || l_linenumber || '/path' as path, case when l_suppkey % 7 = 0 then 'unknown_path' else 'not_indexed' end as code, l_suppkey as s from lineitem where l_suppkey % 7 = 0 or not exists (select 1 from part where p_size % 2 = 0 and p_size % 8 = l_suppkey % 10)",
    "join_mutual_refs": REFERENCES,
    "der_download_rule": DOWNLOADS.format(REFERENCES, "f.ns = 'building' or ", " or not exists (select 1 from f where f.sha256 = sha256(cast(p_partkey as varchar)))"),
    "der_download_anyone": DOWNLOADS.format(REFERENCES, "", ""),
    "op_relation_add": ADDED,
}
SQL["dsl_metric_gate"] = f"select request, path, code from ({SQL['dsl_metric_gate']})"
QUERIES = {name: globals()[name] for name in SQL}
ORACLES = {name: c.sql(text) for name, text in SQL.items()}
