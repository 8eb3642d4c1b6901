"""Queries over the runs of a set and their judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive, filters
from ..operators import runs as run
from ..sources import carriers as c

SET = "src3"


def vocabulary(judgements=None) -> filters.Vocabulary:
    s = filters.Scalar
    return filters.Vocabulary(
        scalars={"status": s(F.col("status"), "string"), "error.kind": s(F.col("error_kind"), "string"), "metrics[core/chars]": s(F.col("chars"), "number"), "state": s(F.col("state"), "string")},
        sides={"results": filters.Side(judgements, "run_id", {"metric": s(F.col("metric"), "string"), "value": s(F.col("value"), "number")})} if judgements is not None else {},
    )


def _keys(spark, d):
    """Adds the metric and the best quality judgement as columns."""

    def extra(rows):
        rows = run.with_metric(rows, c.run_metrics(spark, d), "core/chars", "chars")
        return rows.join(run.best_judgement(c.run_results(spark, d), "quality", "asc", "quality"), ["record_id", "run_id"], "left")

    return extra


def _project(where, sort, spark, d, cursor=None, limit=50, member=False, include=frozenset(), used=False):
    mine = c.runs(spark, d).where(F.col("record_id") == SET)
    judged = c.run_results(spark, d).where(F.col("record_id") == SET)
    cards = c.used_runs(spark, d).where(F.col("record_id") == SET) if used else None
    found = run.project(mine, vocabulary(judged), where, sort, cards, member, include, limit, cursor, _keys(spark, d))
    return found.select("run_id", "status", "state", "error_kind", "chars", "quality")


def src_run_scan(spark, d):
    return run.masked(run.admitted(c.runs(spark, d), None, False), False).select("record_id", "run_id", "status", "state")


def flt_run_rows(spark, d):
    rows = run.admitted(c.runs(spark, d), c.used_runs(spark, d), True, {"archived"})
    return rows.select("record_id", "run_id", "used", run.state(True).alias("state"))


def proj_mask(spark, d):
    rows = run.masked(run.admitted(c.runs(spark, d), c.used_runs(spark, d), False), False)
    return rows.select("record_id", "run_id", "state", "status", "content_hash")


def proj_state(spark, d):
    return c.runs(spark, d).select("record_id", "run_id", run.state(True).alias("member_state"), run.state(False).alias("other_state"))


def flt_run_metric(spark, d):
    rows = run.with_metric(c.runs(spark, d), c.run_metrics(spark, d), "core/chars", "chars")
    return rows.where("chars >= 2000").select("record_id", "run_id", "chars")


def flt_run_result(spark, d):
    hit = c.run_results(spark, d).where("metric = 'quality' and value >= 1").select("record_id", "run_id").distinct()
    return c.runs(spark, d).join(hit, ["record_id", "run_id"], "left_semi").select("record_id", "run_id")


def flt_run_result_exists(spark, d):
    hit = c.run_results(spark, d).where("metric = 'toxic' and value is not null").select("record_id", "run_id").distinct()
    return c.runs(spark, d).join(hit, ["record_id", "run_id"], "left_semi").select("record_id", "run_id")


def _facet(spark, d):
    """A print per run over its language, missing for some."""
    return c.runs(spark, d).where("status <> 'error'").select("record_id", "run_id", F.sha2("lang", 256).alias("fingerprint"))


def flt_run_fp(spark, d):
    rows = c.runs(spark, d).join(_facet(spark, d), ["record_id", "run_id"], "left")
    return rows.where(F.col("fingerprint") != F.sha2(F.lit("en"), 256)).select("record_id", "run_id", "fingerprint")


def proj_pivot_judgements(spark, d):
    rows = run.cells(c.run_results(spark, d))
    return rows.select("record_id", "run_id", F.size("results").alias("judgements"), F.element_at("results", 1)["value"].alias("quality"), F.element_at("results", 2)["value"].alias("toxic"))


def proj_pivot_metrics(spark, d):
    rows = c.run_metrics(spark, d).unionByName(c.run_results(spark, d).select("record_id", "run_id", "metric", "value"))
    return rows.groupBy("record_id", "run_id").pivot("metric", ["core/chars", "quality", "toxic"]).agg(F.first("value")).withColumnRenamed("core/chars", "chars")


def sort_judgement(spark, d):
    return _project(None, [("quality", "asc")], spark, d)


def sort_run_metric(spark, d):
    return _project({"path": "status", "op": "eq", "value": "ok"}, [("chars", "desc")], spark, d)


def page_keyset_nullaware(spark, d):
    return _project(None, [("chars", "desc")], spark, d, cursor=[None, "23"])


def page_keyset_mixed(spark, d):
    return _project(None, [("status", "asc"), ("error_kind", "desc")], spark, d, cursor=["ok", None, "503"], limit=20)


def op_project(spark, d):
    where = {"or": [{"path": "results", "op": "any", "match": {"metric": "quality", "value": 1}}, {"path": "status", "op": "exists"}]}
    return _project(where, [("status", "asc")], spark, d, limit=200, used=True)


def agg_count_filter(spark, d):
    return run.summary(c.runs(spark, d), True)


def agg_count_member(spark, d):
    return run.summary(c.runs(spark, d), False)


def agg_set_hash(spark, d):
    return run.runs_hash(c.runs(spark, d))


def agg_used_summary(spark, d):
    return run.used_summary(c.used_runs(spark, d), c.runs(spark, d)).select("record_id", "runs_used", "used_hash", "posted_hash", F.array_join("changed", ",").alias("changed"))


def join_used_set(spark, d):
    both = c.used_runs(spark, d).join(c.runs(spark, d), ["record_id", "run_id"]).join(_facet(spark, d), ["record_id", "run_id"], "left")
    return both.select("record_id", "run_id", "status", "fingerprint", (F.col("posted_hash") != F.col("content_hash")).alias("changed"))


def agg_same_all(spark, d):
    mine = c.runs(spark, d).select("record_id").distinct().withColumn("fingerprint", F.sha2(F.lit("en"), 256))
    some = c.used_runs(spark, d).select("record_id", "run_id")
    return run.same_all(some, mine, _facet(spark, d))


def set_outside_used(spark, d):
    return c.run_results(spark, d).select("record_id", "run_id").distinct().join(c.used_runs(spark, d).join(c.runs(spark, d).where("status = 'ok'"), ["record_id", "run_id"], "left_semi"), ["record_id", "run_id"], "left_anti")


def set_union_refs(spark, d):
    a = c.runs(spark, d).select(F.lit("run").alias("by"), F.col("content_hash").alias("sha256"))
    b = c.fingerprints(spark, d).select(F.lit("version").alias("by"), F.col("fingerprint").alias("sha256"))
    return a.unionByName(b).groupBy("by").agg(F.count("*").alias("refs"), F.countDistinct("sha256").alias("objects"))


def set_except_missing(spark, d):
    wanted = c.runs(spark, d).select(F.col("content_hash").alias("sha256"))
    ready = c.runs(spark, d).where("lang = 'en'").select(F.col("content_hash").alias("sha256"))
    return wanted.join(ready, "sha256", "left_anti").distinct()


def set_symdiff_keys(spark, d):
    keyed = lambda rows, name: rows.select(F.col("run_id").alias("id"), F.lit(name).alias("key"), F.col("value").cast("string").alias("value"))
    judged = c.run_results(spark, d)
    a = keyed(judged.where("metric = 'quality'"), "q")
    b = keyed(judged.where("metric = 'toxic'"), "q")
    return derive.changed_keys(a, b).select("id", F.array_join("changed", ",").alias("changed"))


def der_run_change(spark, d):
    new = c.used_runs(spark, d).select("record_id", "run_id", F.col("posted_hash").alias("content_hash"))
    return derive.run_changes(new, c.runs(spark, d).where("lang <> 'fr'"))


def der_batch_dup(spark, d):
    batch = c.run_results(spark, d).select("record_id", "run_id", "ordinal")
    return derive.repeated_in_batch(batch, "ordinal").select("record_id", "run_id", "ordinal")


def sink_upsert_run(spark, d):
    old = c.runs(spark, d).select("record_id", "run_id", "content_hash")
    new = c.used_runs(spark, d).select("record_id", "run_id", F.col("posted_hash").alias("content_hash"))
    return derive.upsert(old, new, ["record_id", "run_id"])


def der_used_set(spark, d):
    """A set whose card names runs uses those; others use every live run."""
    named = c.used_runs(spark, d).where("record_id in ('src0', 'src1', 'src2')").select("record_id", "run_id")
    live = c.runs(spark, d).where("not tombstoned and not archived").select("record_id", "run_id")
    chosen = named.unionByName(live.join(named.select("record_id").distinct(), "record_id", "left_anti"))
    return chosen.join(c.runs(spark, d).select("record_id", "run_id", "content_hash"), ["record_id", "run_id"])


def der_extend_used(spark, d):
    old = c.used_runs(spark, d)
    more = c.runs(spark, d).where("status = 'ok'").select("record_id", "run_id", F.col("content_hash").alias("posted_hash"))
    return derive.extend_used(old, more)


def get_run(spark, d):
    rows = c.runs(spark, d).where("record_id = 'src5' and not tombstoned and not archived")
    return rows.select("run_id", "status", "content_hash")


def split_threads(spark, d):
    """Each conversation's first and last turn, and how often the speaker changes."""
    t = c.table(spark, d, "conversations")
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("other", F.coalesce((F.lag("role").over(w) != F.col("role")).cast("int"), F.lit(0)))
    return t.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.sum("other").alias("changes"))


STATE = "case when tombstoned then 'deleted' when archived then '{}' else 'live' end"
UP = "not tombstoned and not archived"
SEEN_RUNS = f"(select r.*, u.run_id is not null as used, {STATE.format('deleted')} as state from runs r left join used_runs u on u.record_id = r.record_id and u.run_id = r.run_id)"
PAGE = "(select r.run_id, r.status, 'live' as state, r.error_kind, m.value as chars, q.value as quality from runs r left join run_metrics m on m.record_id = r.record_id and m.run_id = r.run_id left join run_results q on q.record_id = r.record_id and q.run_id = r.run_id and q.metric = 'quality' where r.record_id = 'src3' and not r.tombstoned and not r.archived) p"
FACET = "(select record_id, run_id, sha256(lang) as fingerprint from runs where status <> 'error')"
PAIRS = "string_agg('[\"' || {0} || '\",\"' || {1} || '\"]', ',' order by {0})"
SQL = {
    "src_run_scan": f"select record_id, run_id, status, 'live' as state from runs where {UP}",
    "flt_run_rows": f"select r.record_id, r.run_id, u.run_id is not null as used, {STATE.format('archived')} as state from runs r left join used_runs u on u.record_id = r.record_id and u.run_id = r.run_id where not tombstoned or u.run_id is not null",
    "proj_mask": f"select record_id, run_id, state, case when {UP} then status end as status, case when {UP} then content_hash end as content_hash from {SEEN_RUNS} where ({UP}) or used",
    "proj_state": f"select record_id, run_id, {STATE.format('archived')} as member_state, {STATE.format('deleted')} as other_state from runs",
    "flt_run_metric": "select r.record_id, r.run_id, m.value as chars from runs r join run_metrics m on m.record_id = r.record_id and m.run_id = r.run_id where m.value >= 2000",
    "flt_run_result": "select record_id, run_id from runs r where exists (select 1 from run_results j where j.record_id = r.record_id and j.run_id = r.run_id and j.metric = 'quality' and j.value >= 1)",
    "flt_run_result_exists": "select record_id, run_id from runs r where exists (select 1 from run_results j where j.record_id = r.record_id and j.run_id = r.run_id and j.metric = 'toxic' and j.value is not null)",
    "flt_run_fp": "select record_id, run_id, sha256(lang) as fingerprint from runs where status <> 'error' and lang <> 'en'",
    "proj_pivot_judgements": "select record_id, run_id, count(*) as judgements, max(value) filter (where metric = 'quality') as quality, max(value) filter (where metric = 'toxic') as toxic from run_results group by all",
    "proj_pivot_metrics": "select record_id, run_id, max(value) filter (where metric = 'core/chars') as chars, max(value) filter (where metric = 'quality') as quality, max(value) filter (where metric = 'toxic') as toxic from (select record_id, run_id, metric, value from run_metrics union all select record_id, run_id, metric, value from run_results) group by all",
    "sort_judgement": f"select * from {PAGE} order by quality nulls last, run_id limit 51",
    "sort_run_metric": f"select * from {PAGE} where status = 'ok' order by chars desc nulls first, run_id desc limit 51",
    "page_keyset_nullaware": f"select * from {PAGE} where chars is not null or run_id < '23' order by chars desc nulls first, run_id desc limit 51",
    "page_keyset_mixed": f"select * from {PAGE} where status > 'ok' or (status = 'ok' and error_kind is not null) or (status = 'ok' and error_kind is null and run_id < '503') order by status, error_kind desc nulls first, run_id desc limit 21",
    "op_project": f"select r.run_id, case when {UP} then r.status end as status, r.state, case when {UP} then r.error_kind end as error_kind, m.value as chars, q.value as quality from {SEEN_RUNS} r left join run_metrics m on m.record_id = r.record_id and m.run_id = r.run_id left join run_results q on q.record_id = r.record_id and q.run_id = r.run_id and q.metric = 'quality' where r.record_id = 'src3' and (({UP}) or used) and (q.value = 1 or ({UP})) order by status nulls last, r.run_id limit 201",
    "agg_count_filter": f"select record_id, count(*) filter (where {UP}) as live, count(*) filter (where {UP} and status = 'ok') as ok, count(*) filter (where {UP} and status = 'error') as error, count(*) filter (where {UP} and status = 'skipped') as skipped, count(*) filter (where archived and not tombstoned) as archived_runs, count(*) filter (where tombstoned) as deleted, count(*) as total from runs group by 1",
    "agg_count_member": f"select record_id, count(*) filter (where {UP}) as live, count(*) filter (where {UP} and status = 'ok') as ok, count(*) filter (where {UP} and status = 'error') as error, count(*) filter (where {UP} and status = 'skipped') as skipped, cast(null as bigint) as archived_runs, cast(null as bigint) as deleted, count(*) as total from runs group by 1",
    "agg_set_hash": f"select record_id, sha256('[' || {PAIRS.format('run_id', 'content_hash')} || ']') as runs_hash from runs group by 1",
    "agg_used_summary": f"select u.record_id, count(*) as runs_used, sha256('[' || {PAIRS.format('r.run_id', 'r.content_hash')} || ']') as used_hash, sha256('[' || {PAIRS.format('r.run_id', 'u.posted_hash')} || ']') as posted_hash, coalesce(string_agg(r.run_id, ',' order by r.run_id) filter (where u.posted_hash <> r.content_hash), '') as changed from used_runs u join runs r on r.record_id = u.record_id and r.run_id = u.run_id group by 1",
    "join_used_set": f"select u.record_id, u.run_id, r.status, f.fingerprint, u.posted_hash <> r.content_hash as changed from used_runs u join runs r on r.record_id = u.record_id and r.run_id = u.run_id left join {FACET} f on f.record_id = u.record_id and f.run_id = u.run_id",
    "agg_same_all": f"select s.record_id, count(u.run_id) > 0 and bool_and(coalesce(f.fingerprint = sha256('en'), false)) as same from (select distinct record_id from runs) s left join used_runs u on u.record_id = s.record_id left join {FACET} f on f.record_id = u.record_id and f.run_id = u.run_id group by 1",
    "set_outside_used": "select distinct record_id, run_id from run_results j where not exists (select 1 from used_runs u join runs r on r.record_id = u.record_id and r.run_id = u.run_id and r.status = 'ok' where u.record_id = j.record_id and u.run_id = j.run_id)",
    "set_union_refs": "select 'run' as by, count(*) as refs, count(distinct content_hash) as objects from runs union all select 'version', count(*), count(distinct fingerprint) from fingerprints",
    "set_except_missing": "select content_hash as sha256 from runs except select content_hash from runs where lang = 'en'",
    "set_symdiff_keys": "select q.run_id as id, 'q' as changed from run_results q join run_results t on t.record_id = q.record_id and t.run_id = q.run_id where q.metric = 'quality' and t.metric = 'toxic' and q.value <> t.value",
    "der_run_change": "select u.record_id, u.run_id, case when r.run_id is null then 'created' when r.tombstoned then 'refused' when r.content_hash = u.posted_hash then 'unchanged' else 'updated' end as change from used_runs u left join (select * from runs where lang <> 'fr') r on r.record_id = u.record_id and r.run_id = u.run_id",
    "der_batch_dup": "select record_id, run_id, ordinal from run_results where ordinal = 1",
    "sink_upsert_run": "select r.record_id, r.run_id, coalesce(u.posted_hash, r.content_hash) as content_hash from runs r left join used_runs u on u.record_id = r.record_id and u.run_id = r.run_id",
    "der_used_set": f"select record_id, run_id, content_hash from runs r where (record_id in ('src0', 'src1', 'src2') and exists (select 1 from used_runs u where u.record_id = r.record_id and u.run_id = r.run_id)) or (({UP}) and record_id not in (select record_id from used_runs where record_id in ('src0', 'src1', 'src2')))",
    "der_extend_used": "select r.record_id, r.run_id, coalesce(u.posted_hash, r.content_hash) as posted_hash from runs r left join used_runs u on u.record_id = r.record_id and u.run_id = r.run_id where u.run_id is not null or r.status = 'ok'",
    "get_run": f"select run_id, status, content_hash from runs where record_id = 'src5' and {UP}",
    "split_threads": "select conv_id, min(turn) as first, max(turn) as last, sum(other) as changes from (select *, coalesce(cast(lag(role) over (partition by conv_id order by turn) <> role as int), 0) as other from conversations) group by 1",
}

QUERIES = {name: globals()[name] for name in SQL}
ORACLES = {name: c.sql(text) for name, text in SQL.items()}
