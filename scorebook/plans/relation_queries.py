"""Queries over relations as a reader may see them: filters, resolution, and what bodies withhold."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import filters, graph
from ..operators import records as rec
from ..operators import relations as rel
from ..sources import carriers as c
from ..sources.staged import keep

CALLER = ["building"]
SEEN = "({0}.visibility = 'public' or {0}.ns in ('building'))"
OPEN = "({0}.visibility = 'public')"


def _search(where: dict, caller: list[str], spark, d):
    """Live visible versions of all numbers that pass a filter on relations, attachments or type."""
    targets = c.hub_targets(spark, d)
    words = filters.Vocabulary(
        scalars={"type": filters.Scalar(F.col("type"), "string"), "name": filters.Scalar(F.col("name"), "string")},
        sides={"relations": rel.side(c.relations(spark, d), targets, caller), "attachments": rel.attachment_side(c.attachment_refs(spark, d))},
    )
    rows = rec.scan(c.hub_records(spark, d), c.hub_versions(spark, d), caller, every=True)
    return filters.apply(rows, where, words).select("version_id", "record_id", "seq")


def any_(side: str, /, **match) -> dict:
    return {"path": side, "op": "any", "match": match}


USES = any_("relations", type="core/uses_eval", to={"op": "prefix", "value": "building/"})
LOGS = any_("attachments", path={"op": "prefix", "value": "logs/3"}, sha256={"op": "gte", "value": "8"})


def _edge_sql(seen: str, terms: str) -> str:
    """EXISTS inside EXISTS, and the target's address as a correlated value."""
    to = "coalesce(x.to_external, (select t.address from hub_targets t where t.version_id = x.to_version_id))"
    inner = f"(x.to_version_id is null or exists (select 1 from hub_targets t where t.version_id = x.to_version_id and {seen.format('t')}))"
    return f"exists (select 1 from relations x where x.from_version_id = v.version_id and {inner} and {terms.format(to=to)})"


USES_SQL = "x.type = 'core/uses_eval' and {to} like 'building/%'"
LOGS_SQL = "exists (select 1 from attachment_refs a where a.version_id = v.version_id and a.path like 'logs/3%' and a.sha256 >= '8')"
#: name: (filter, the reader's namespaces, its SQL condition)
FILTERS = {
    "flt_any_relations": (USES, CALLER, _edge_sql(SEEN, USES_SQL)),
    "flt_any_relations_stranger": (USES, [], _edge_sql(OPEN, USES_SQL)),
    "flt_any_relations_not": ({"and": [{"not": any_("relations", to={"op": "contains", "value": "/c1"})}, {"path": "type", "op": "eq", "value": "card"}]}, CALLER, f"not {_edge_sql(SEEN, '{to} like ' + repr('%/c1%'))} and v.type = 'card'"),
    "join_nested_exists": ({"or": [any_("relations", type="core/compares", to={"op": "ne", "value": "hf:org/set@1"}), {"path": "name", "op": "eq", "value": "c7"}]}, [], f"{_edge_sql(OPEN, 'x.type = ' + repr('core/compares') + ' and {to} <> ' + repr('hf:org/set@1'))} or v.name = 'c7'"),
    "flt_any_attachments": ({"and": [LOGS, USES]}, CALLER, f"{LOGS_SQL} and {_edge_sql(SEEN, USES_SQL)}"),
}


def join_edge_target(spark, d):
    """Every edge as a reader sees it: resolved by id, by its text at last, private, or text."""
    targets = keep(c.hub_targets(spark, d).select("version_id", "type", "ns", "name", "seq", "visibility", "tombstoned", "content_hash", "address"))
    rows = rel.resolve(c.relations(spark, d, targets), targets, CALLER)
    return rows.select("from_version_id", "ordinal", "type", "kind", "version_id", "address", "tombstoned", "content_hash", "text")


def join_resolve_ingest(spark, d):
    """What each written address is stored as: the one visible eval or card by it, else nothing."""
    refs = c.relations(spark, d).where("to_external is not null").select(F.col("to_external").alias("text")).distinct()
    targets = c.hub_targets(spark, d)
    any_type, evals = rel.resolve_written(refs, targets, CALLER), rel.resolve_written(refs, targets, CALLER, "eval")
    return any_type.join(evals.withColumnRenamed("resolved", "resolved_eval"), "text")


def graph_hidden_targets(spark, d):
    return rel.hidden_targets(c.relations(spark, d), c.hub_targets(spark, d), CALLER)


def graph_private_node(spark, d):
    """Nodes within two hops of the evals' edges; those that the reader may not see are walked through and show a hash alone."""
    targets = c.hub_targets(spark, d)
    edges = c.relations(spark, d).where("to_version_id is not null").select(F.col("from_version_id").alias("from_id"), "type", F.col("to_version_id").alias("to_id"))
    start = targets.where("type = 'eval' and seq = 1").select(F.col("version_id").alias("node"))
    met = graph.traverse(edges, start, 2)
    own = targets.select(F.col("version_id").alias("node"), "address", "content_hash", rec.visible(CALLER).alias("seen"))
    return met.join(own, "node").select("node", "distance", (~F.col("seen")).alias("private"), F.when(F.col("seen"), F.col("address")).alias("address"), F.when(~F.col("seen"), F.col("content_hash")).alias("content_hash"))


def agg_hidden_evals(spark, d):
    return rel.hidden_evals(c.verdicts(spark, d), c.hub_records(spark, d), CALLER)


def card_bodies(spark, d, targets=None, relations=None, verdicts=None):
    """Bodies with relations and judgements in their order, as text in canonical form; some have neither."""
    targets, records = c.hub_targets(spark, d) if targets is None else targets, c.hub_records(spark, d)
    relations, verdicts = c.relations(spark, d) if relations is None else relations, c.verdicts(spark, d) if verdicts is None else verdicts
    by_id = targets.select(F.col("version_id").alias("to_version_id"), "address")
    # edges without an id are not joined: their nulls would meet in one task
    to = F.coalesce("to_external", "address").alias("to")
    known = relations.where("to_version_id is not null").join(by_id, "to_version_id", "left").select("from_version_id", "ordinal", "type", to)
    edges = known.unionByName(relations.where("to_version_id is null").select("from_version_id", "ordinal", "type", F.col("to_external").alias("to"))).where(F.col("to").isNotNull())
    edges = edges.groupBy("from_version_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct("to", "type").alias("e")))).alias("r"))
    evals = records.select(F.col("record_id").alias("eval_record_id"), F.concat("ns", F.lit("/"), "name").alias("eval"))
    judged = verdicts.join(evals, "eval_record_id").groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct("eval", "metric", "run_id", "value").alias("e")))).alias("j"))
    rows = targets.join(edges.withColumnRenamed("from_version_id", "version_id"), "version_id", "left").join(judged, "version_id", "left")
    body = F.struct(F.transform("r", lambda x: x["e"]).alias("relations"), F.transform("j", lambda x: x["e"]).alias("run_results"), F.col("name").alias("title"))
    return rows.select("version_id", F.to_json(body).alias("body"))


def proj_withhold(spark, d):
    """Bodies as a reader gets them, with the commitments of the edges and the number of judgements that went."""
    targets = keep(c.hub_targets(spark, d))
    relations = keep(c.relations(spark, d))
    hidden = rel.hidden_targets(relations, targets, CALLER)
    verdicts = c.verdicts(spark, d)
    evals = rel.hidden_evals(verdicts, c.hub_records(spark, d), CALLER)
    found = rel.withhold(card_bodies(spark, d, targets, relations, verdicts), hidden, evals)
    line = lambda x: F.concat(x["type"], F.lit(" "), x["version_id"].cast("string"), F.lit(" "), x["content_hash"])
    return found.select("version_id", "body", F.array_join(F.transform("withheld_relations", line), ",").alias("withheld_relations"), "withheld_run_results")


EDGE_ITEM = """'{"to":"' || coalesce(x.to_external, t.address) || '","type":"' || x.type || '"}'"""
JUDGED_ITEM = """'{"eval":"' || e.ns || '/' || e.name || '","metric":"' || j.metric || '","run_id":"' || j.run_id || '","value":' || j.value || '}'"""
# An element goes by what it names: a textual one too, if the version also has a resolved edge of its type there.
HIDDEN_EDGES = f"(select x.from_version_id, x.type, t.address, min(t.version_id) as id, arg_min(t.content_hash, t.version_id) as h from relations x join hub_targets t on t.version_id = x.to_version_id where not {SEEN.format('t')} group by 1, 2, 3)"
# A judgement goes by the name of its eval, which a visible card may share.
UNSEEN = f"exists (select 1 from verdicts k join hub_records f on f.record_id = k.eval_record_id where k.version_id = j.version_id and f.ns = e.ns and f.name = e.name and not {SEEN.format('f')})"
WITHHELD = f"""
with h as {HIDDEN_EDGES}, edge as (
    select x.from_version_id as version_id, x.ordinal, {EDGE_ITEM} as item, x.type, h.id, h.h
    from relations x left join hub_targets t on t.version_id = x.to_version_id
    left join h on h.from_version_id = x.from_version_id and h.type = x.type and h.address = coalesce(x.to_external, t.address)
    where coalesce(x.to_external, t.address) is not null
), e as (
    select version_id, string_agg(item, ',' order by ordinal) filter (where id is null) as kept,
           string_agg(type || ' ' || id || ' ' || h, ',' order by ordinal) filter (where id is not null) as gone
    from edge group by 1
), r as (
    select j.version_id, string_agg({JUDGED_ITEM}, ',' order by j.ordinal) filter (where not {UNSEEN}) as kept, count(*) filter (where {UNSEEN}) as gone
    from verdicts j join hub_records e on e.record_id = j.eval_record_id group by 1
)
select v.version_id,
       '{{' || case when e.version_id is not null then '"relations":[' || coalesce(e.kept, '') || '],' else '' end
            || case when r.version_id is not null then '"run_results":[' || coalesce(r.kept, '') || '],' else '' end
            || '"title":"' || v.name || '"}}' as body,
       case when e.gone is not null or r.gone > 0 then coalesce(e.gone, '') end as withheld_relations,
       case when e.gone is not null or r.gone > 0 then coalesce(r.gone, 0) end as withheld_run_results
from hub_targets v left join e on e.version_id = v.version_id left join r on r.version_id = v.version_id
"""

TEXT_FORM = "regexp_full_match(x.to_external, '[^/]+/[^/]+@[0-9]+')"
FIRST = f"(select ns, name, seq, arg_min(version_id, type) as version_id, arg_min(tombstoned, type) as tombstoned, any_value(address) as address from hub_targets t where {SEEN.format('t')} group by 1, 2, 3)"
ONE = f"(select address, case when count(*) = 1 then min(version_id) end as resolved from hub_targets t where {SEEN.format('t')} group by 1)"
SQL = {
    "join_edge_target": f"""select x.from_version_id, x.ordinal, x.type,
        case when t.version_id is not null then case when {SEEN.format('t')} then 'version' else 'private' end when f.version_id is not null then 'version' when x.to_external like 'external:%' or x.to_external like 'hf:%' then 'external' else 'unresolved' end as kind,
        coalesce(t.version_id, f.version_id) as version_id, case when t.version_id is not null then case when {SEEN.format('t')} then t.address end else f.address end as address,
        case when t.version_id is not null then case when {SEEN.format('t')} then t.tombstoned end else f.tombstoned end as tombstoned,
        case when not {SEEN.format('t')} then t.content_hash end as content_hash, case when t.version_id is null and f.version_id is null then coalesce(x.to_external, '') end as text
        from relations x left join hub_targets t on t.version_id = x.to_version_id left join {FIRST} f on x.to_version_id is null and {TEXT_FORM} and f.address = x.to_external""",
    "join_resolve_ingest": f"select x.text, a.resolved, b.resolved as resolved_eval from (select distinct to_external as text from relations where to_external is not null) x left join {ONE} a on a.address = x.text left join {ONE.replace('where', "where t.type = 'eval' and", 1)} b on b.address = x.text",
    "graph_hidden_targets": f"select x.from_version_id, x.type as relation, t.ns, t.name, t.seq, t.version_id, t.content_hash from relations x join hub_targets t on t.version_id = x.to_version_id where not {SEEN.format('t')}",
    "graph_private_node": f"with recursive walk(node, distance) as (select version_id, 0 from hub_targets where type = 'eval' and seq = 1 union select x.to_version_id, w.distance + 1 from walk w join relations x on x.from_version_id = w.node where x.to_version_id is not null and w.distance < 2) select w.node, w.distance, not {SEEN.format('t')} as private, case when {SEEN.format('t')} then t.address end as address, case when not {SEEN.format('t')} then t.content_hash end as content_hash from (select node, min(distance) as distance from walk group by 1) w join hub_targets t on t.version_id = w.node",
    "agg_hidden_evals": f"select j.version_id, j.eval_record_id, count(*) as judgements, e.ns, e.name from verdicts j join hub_records e on e.record_id = j.eval_record_id where not {SEEN.format('e')} group by all",
    "proj_withhold": WITHHELD.strip(),
} | {
    name: f"select v.version_id, v.record_id, v.seq from hub_targets v where {(SEEN if caller else OPEN).format('v')} and not v.tombstoned and ({condition})" for name, (_, caller, condition) in FILTERS.items()
}

QUERIES = {name: globals()[name] for name in SQL if name not in FILTERS} | {name: partial(_search, where, caller) for name, (where, caller, _) in FILTERS.items()}
ORACLES = {name: c.sql(text) for name, text in SQL.items()}
