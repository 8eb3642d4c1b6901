"""Changes of state that leave bodies and hashes alone: labels, visibility, tombstones, archived runs; who may do what, and
which references let a reader download an object.

Requests come in batches and take effect in order of ``position``, which is unique in a batch. Each operator returns the table
after the batch, what was refused with why, and the audit rows of what was done. Requests that change nothing leave no audit row
where that is said.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import keep
from . import relations, used_sets
from .records import live, visible


@dataclass
class Changed:
    """The table after the batch, refusals (position, code) and audit rows (position, action, subject, detail)."""

    rows: DataFrame
    refused: DataFrame
    audit: DataFrame


def _audit(done: DataFrame, action: Column, subject: Column, detail: Column) -> DataFrame:
    return done.select("position", action.alias("action"), subject.cast("string").alias("subject"), detail.alias("detail"))


def _text(**fields: str) -> Column:
    """A JSON object of columns; a null field is left out."""
    return F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()]))


def move_labels(versions: DataFrame, requests: DataFrame) -> Changed:
    """Point labels at versions; a label leaves the version that held it, and a version has one label.

    versions: version_id, record_id, seq, label and more. requests: position, record_id, seq, label. A label that is null, empty or
    of digits alone is ``label_invalid``, then an unknown version ``version_not_found``; neither takes the label from its holder.
    The end of the batch follows from two maxima: a version keeps the label of its last request if that is also the label's last
    request in the record, and one without requests keeps its own if nobody asked for it.
    """
    bad = F.coalesce(F.col("label").rlike(r"\A[0-9]*\z"), F.lit(True))
    asked = requests.join(versions.select("record_id", "seq", F.lit(True).alias("_there")), ["record_id", "seq"], "left")
    asked = asked.withColumn("code", F.when(bad, "label_invalid").when(F.col("_there").isNull(), "version_not_found"))
    good = asked.where("code is null").select("position", "record_id", "seq", "label")
    by_version = good.groupBy("record_id", "seq").agg(F.max("position").alias("_at"), F.max_by("label", "position").alias("_new"))
    by_label = good.groupBy("record_id", "label").agg(F.max("position").alias("_last"))
    new = by_version.join(by_label, (by_version["record_id"] == by_label["record_id"]) & (F.col("_new") == F.col("label")) & (F.col("_at") == F.col("_last")), "left")
    new = new.select(by_version["record_id"], "seq", F.col("label").alias("_new"), F.lit(True).alias("_asked"))
    taken = by_label.select("record_id", "label", F.lit(True).alias("_taken"))
    rows = versions.join(new, ["record_id", "seq"], "left").join(taken, ["record_id", "label"], "left")
    label = F.when(F.col("_asked"), F.col("_new")).when(F.col("_taken").isNull(), F.col("label"))
    rows = rows.withColumn("label", label).select(*versions.columns)
    subject = F.concat(F.col("record_id").cast("string"), F.lit("@"), F.col("seq").cast("string"))
    return Changed(rows, asked.where("code is not null").select("position", "code"), _audit(good, F.lit("label.set"), subject, _text(label="label")))


def set_visibility(records: DataFrame, requests: DataFrame) -> Changed:
    """The last request of a record counts. requests: position, record_id, visibility. Setting what is set is audited too."""
    asked = requests.join(records.select("record_id", F.lit(True).alias("_there")), "record_id", "left")
    known = F.col("visibility").isin("public", "private") & F.col("visibility").isNotNull()
    asked = asked.withColumn("code", F.when(F.col("_there").isNull(), "record_not_found").when(~F.coalesce(known, F.lit(False)), "bad_request"))
    good = asked.where("code is null")
    last = good.groupBy("record_id").agg(F.max_by("visibility", "position").alias("_new"))
    rows = records.join(last, "record_id", "left").withColumn("visibility", F.coalesce("_new", "visibility")).select(*records.columns)
    return Changed(rows, asked.where("code is not null").select("position", "code"), _audit(good, F.lit("settings.visibility"), F.col("record_id"), _text(visibility="visibility")))


def tombstone_versions(versions: DataFrame, requests: DataFrame, refs: DataFrame) -> tuple[Changed, DataFrame]:
    """(versions, the references of attachments that are left). The body goes and the reason comes; number, label, hash and badges
    stay. A version is tombstoned once: later requests are ``already_tombstoned``, of a version that is not there ``version_not_found``.

    versions: version_id, record_id, seq, body, tombstoned, reason, note and more. requests: position, record_id, seq, reason, note.
    """
    there = versions.select("record_id", "seq", "version_id", F.col("tombstoned").alias("_gone"))
    asked = requests.join(there, ["record_id", "seq"], "left")
    first = asked.where("version_id is not null and not _gone").groupBy("version_id").agg(F.min_by(F.struct("position", "reason", "note"), "position").alias("_do"))
    asked = asked.join(first.select("version_id", F.col("_do.position").alias("_first")), "version_id", "left")
    code = F.when(F.col("version_id").isNull(), "version_not_found").when(F.col("_gone") | (F.col("position") != F.col("_first")), "already_tombstoned")
    asked = asked.withColumn("code", code)
    hit = F.col("_do").isNotNull()
    rows = versions.join(first, "version_id", "left")
    rows = rows.withColumn("tombstoned", F.col("tombstoned") | hit).withColumn("body", F.when(~hit, F.col("body")))
    rows = rows.withColumn("reason", F.coalesce("_do.reason", "reason")).withColumn("note", F.when(hit, F.col("_do.note")).otherwise(F.col("note"))).select(*versions.columns)
    left = refs.join(first.select("version_id"), "version_id", "left_anti").select(*refs.columns)
    subject = F.concat(F.col("record_id").cast("string"), F.lit("@"), F.col("seq").cast("string"))
    audit = _audit(asked.where("code is null"), F.lit("version.tombstone"), subject, _text(version_id="version_id", reason="reason", note="note"))
    return Changed(rows, asked.where("code is not null").select("position", "code"), audit), left


def change_runs(runs: DataFrame, requests: DataFrame, versions: DataFrame, refs: DataFrame) -> tuple[Changed, DataFrame]:
    """(runs, the references of run attachments that are left) after requests to ``archive``, ``unarchive`` and ``delete`` runs.

    runs: record_id, run_id, body, content_hash, archived, tombstoned, reason, note and more. requests: position, record_id, run_id,
    action, reason, note. versions: record_id, tombstoned. Another action is a ``bad_request`` whatever the run; without a live version of the record nothing can be asked of its runs
    (``record_not_found``); then ``run_not_found``; a deleted run, also one deleted earlier in the batch, is ``run_deleted``. A run
    that is in the asked state already stays as it is, without an audit row. Hash, archived state and metrics outlive a deletion.
    The state before a request is the last one asked for, by a window over the requests of a run.
    """
    headers = live(versions).select("record_id").distinct().withColumn("_header", F.lit(True))
    now = runs.select("record_id", "run_id", "content_hash", F.col("archived").alias("_archived"), F.col("tombstoned").alias("_gone"))
    asked = requests.join(headers, "record_id", "left").join(now, ["record_id", "run_id"], "left")
    wrong = F.when(~F.coalesce(F.col("action").isin("archive", "unarchive", "delete"), F.lit(False)), "bad_request")
    wrong = wrong.when(F.col("_header").isNull(), "record_not_found").when(F.col("_gone").isNull(), "run_not_found").when(F.col("_gone"), "run_deleted")
    asked = asked.withColumn("code", wrong)
    before = Window.partitionBy("record_id", "run_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    open_ = asked.where("code is null").withColumn("_deleted", F.coalesce(F.max(F.col("action") == "delete").over(before), F.lit(False)))
    state = F.when(F.col("action") == "archive", True).when(F.col("action") == "unarchive", False)
    open_ = open_.withColumn("_was", F.coalesce(F.last(state, ignorenulls=True).over(before), "_archived"))
    good = open_.where("not _deleted and (action = 'delete' or _was <> (action = 'archive'))")
    late = open_.where("_deleted").select("position", F.lit("run_deleted").alias("code"))

    end = good.groupBy("record_id", "run_id").agg(F.max_by(state, F.when(state.isNotNull(), F.col("position"))).alias("_state"), F.min_by(F.struct("reason", "note"), F.when(F.col("action") == "delete", F.col("position"))).alias("_do"))
    rows = runs.join(end, ["record_id", "run_id"], "left")
    gone = F.col("_do").isNotNull()
    rows = rows.withColumn("archived", F.coalesce("_state", "archived")).withColumn("tombstoned", F.col("tombstoned") | gone).withColumn("body", F.when(~gone, F.col("body")))
    rows = rows.withColumn("reason", F.coalesce("_do.reason", "reason")).withColumn("note", F.when(gone, F.col("_do.note")).otherwise(F.col("note"))).select(*runs.columns)
    left = refs.join(end.where("_do is not null").select("record_id", "run_id"), ["record_id", "run_id"], "left_anti").select(*refs.columns)
    subject = F.concat(F.col("record_id").cast("string"), F.lit("/runs/"), F.col("run_id"))
    audit = _audit(good, F.concat(F.lit("run."), F.col("action")), subject, _text(content_hash="content_hash", reason="reason", note="note"))
    return Changed(rows, asked.where("code is not null").select("position", "code").unionByName(late), audit), left


# --- who may do what. Scopes in rising order.
SCOPES = ("read", "write", "admin")


def level(scope: Column) -> Column:
    """Place of a scope on the scale from 0; null for another text."""
    return F.coalesce(*[F.when(scope == name, F.lit(i)) for i, name in enumerate(SCOPES)])


def effective_scopes(tokens: DataFrame, covered: DataFrame, members: DataFrame) -> DataFrame:
    """What each token may do where: token_id, ns, scope. tokens: token_id, user_id, login, scope. covered: token_id, ns. members:
    user_id, ns, role.

    In the user's own namespace that is the token's scope, in an organisation the lesser of it and the user's role; a namespace
    that the token does not cover, or an organisation that the user is no member of, has no row.
    """
    each = covered.select("token_id", "ns").distinct().join(tokens.withColumn("_scope", level(F.col("scope"))).drop("scope"), "token_id")
    roles = members.groupBy("user_id", "ns").agg(F.max(level(F.col("role"))).alias("_role"))
    found = each.join(roles, ["user_id", "ns"], "left")
    may = F.when(F.col("ns") == F.col("login"), F.col("_scope")).when(F.col("_role").isNotNull(), F.least("_scope", "_role"))
    named = F.coalesce(*[F.when(may == i, name) for i, name in enumerate(SCOPES)])
    return found.select("token_id", "ns", named.alias("scope")).where("scope is not null")


def permitted(asked: DataFrame, scopes: DataFrame) -> DataFrame:
    """Which actions (token_id, ns, needs) a token may take: the rows with ``allowed``. No token may take none."""
    have = scopes.select("token_id", "ns", level(F.col("scope")).alias("_have"))
    return asked.join(have, ["token_id", "ns"], "left").withColumn("allowed", F.coalesce(F.col("_have") >= level(F.col("needs")), F.lit(False))).drop("_have")


def metric_gate(sorts: DataFrame, registry: DataFrame) -> DataFrame:
    """Errors of searches that sort by metrics (request, place, metric): path and code, none for registered ones of any version.

    A metric is named ``ns/id``; what holds no slash is an ``unknown_path``, an unregistered one ``not_indexed``.
    registry: kind, ns, id, version.
    """
    known = registry.where("kind = 'metrics'").select(F.concat("ns", F.lit("/"), "id").alias("metric")).distinct().withColumn("_known", F.lit(True))
    rows = sorts.join(known, "metric", "left").where("_known is null")
    code = F.when(F.coalesce(F.contains("metric", F.lit("/")), F.lit(False)), "not_indexed").otherwise("unknown_path")
    return rows.select("request", F.concat(F.lit("/sort/"), F.col("place").cast("string"), F.lit("/path")).alias("path"), code.alias("code"))


# --- references of objects


def referencing(refs: DataFrame, run_refs: DataFrame, versions: DataFrame, runs: DataFrame, records: DataFrame) -> DataFrame:
    """What refers to each object: sha256, ns, visibility, version_id or record_id with run_id, archived.

    A reference of a version counts as long as it is there; one of a run only while its record has a live version. refs: version_id,
    sha256. run_refs: record_id, run_id, sha256.
    """
    own = records.select("record_id", "ns", "visibility")
    none = F.lit(None)
    by_version = refs.join(versions.select("version_id", "record_id"), "version_id").join(own, "record_id")
    by_version = by_version.select("sha256", "ns", "visibility", "version_id", none.cast(records.schema["record_id"].dataType).alias("record_id"), none.cast("string").alias("run_id"), F.lit(False).alias("archived"))
    readable = own.join(live(versions).select("record_id"), "record_id", "left_semi")
    by_run = run_refs.select("record_id", "run_id", "sha256").distinct().join(runs.select("record_id", "run_id", "archived"), ["record_id", "run_id"]).join(readable, "record_id")
    by_run = by_run.select("sha256", "ns", "visibility", none.cast(versions.schema["version_id"].dataType).alias("version_id"), "record_id", "run_id", "archived")
    return by_version.unionByName(by_run)


def may_download(objects: DataFrame, references: DataFrame, caller: list[str] | None) -> DataFrame:
    """The ready objects (sha256, state) that a reader may download; ``caller`` is None for one without a token.

    Any public reference lets everyone, one in a namespace of the reader's lets the reader; an archived run's lets members alone.
    An object without any reference is an upload under way: any token will do.
    """
    member = F.col("ns").isin(caller) if caller else F.lit(False)
    ok = references.groupBy("sha256").agg(F.bool_or(member | ((F.col("visibility") == "public") & ~F.col("archived"))).alias("_ok"))
    ready = objects.where("state = 'ready'").join(ok, "sha256", "left")
    return ready.where(F.coalesce("_ok", F.lit(caller is not None))).select(*objects.columns)


# --- edges added later


@dataclass
class Added:
    """Edges as they are stored, runs that join used sets, and errors (position, path, code)."""

    edges: DataFrame
    used: DataFrame
    errors: DataFrame
    audit: DataFrame


def add_relations(requests: DataFrame, edges: DataFrame, targets: DataFrame, used: DataFrame, runs: DataFrame, records: DataFrame, writer: list[str]) -> Added:
    """Add edges to versions that are there. requests: position, from_version_id, type, to, attrs.

    A target resolves if the writer, or a member of the namespace of the edge's own version, may see it; else it stays text. An
    edge by which a card uses an eval adds runs to the card's used set: those that this edge or an earlier one names, or every live
    run where none names any. Runs that are recorded keep their hash and are never taken out. An edge that names an unknown run is
    refused whole; an unknown version is ``source_version_unknown``.

    targets: versions with type, ns, name, seq, visibility, record_id. used: version_id, eval_record_id, run_id, content_hash.
    """
    targets, runs = keep(targets), keep(runs)
    own = targets.select(F.col("version_id").alias("from_version_id"), F.col("type").alias("_type"), F.col("ns").alias("_ns"))
    asked = keep(requests.join(own, "from_version_id", "left").withColumn("_t", relations.hub_target(F.col("to"))))
    lost = asked.where("_type is null").select("position", F.lit("/from").alias("path"), F.lit("source_version_unknown").alias("code"))
    there = asked.where("_type is not null")
    # the target of the lowest type name among those that are visible to this writer; the namespace rule differs by edge
    cand = targets.select("ns", "name", "seq", F.col("version_id").alias("_to"), F.col("type").alias("_to_type"), "record_id", visible(writer).alias("_seen"))
    named = there.where("_t is not null").select("position", "_ns", "_t.*").join(cand, ["ns", "name", "seq"]).where("_seen or ns = _ns")
    hit = named.groupBy("position").agg(F.count("*").alias("_n"), F.min(F.struct("_to_type", "_to", "record_id", "ns", "name")).alias("_hit")).where("_n = 1").drop("_n")
    placed = keep(there.join(hit, "position", "left").withColumn("to_version_id", F.col("_hit._to")))

    uses = placed.where((F.col("type") == used_sets.USES) & (F.col("_type") == "card") & (F.col("_hit._to_type") == "eval"))
    new = uses.select(F.col("from_version_id").alias("version_id"), F.col("position").alias("ordinal"), "type", F.col("_hit.ns").alias("ns"), F.col("_hit.name").alias("name"), F.col("_hit.record_id").alias("eval_record_id"), "attrs")
    each = keep(used_sets.uses(new))
    known = runs.select(F.col("record_id").alias("eval_record_id"), "run_id").withColumn("_known", F.lit(True))
    asked_runs = each.select(F.col("ordinal").alias("position"), "eval_record_id", F.posexplode("named").alias("k", "run_id")).join(known, ["eval_record_id", "run_id"], "left")
    unknown = asked_runs.where("_known is null").select("position", F.concat(F.lit("/attrs/runs/"), F.col("k").cast("string")).alias("path"), F.lit("run_unknown").alias("code"))
    refused = unknown.select("position").distinct()

    kept = placed.join(refused, "position", "left_anti")
    stored = kept.select("position", "from_version_id", "type", "to_version_id", F.when(F.col("to_version_id").isNull(), F.col("to")).alias("to_external"), "attrs")
    good = each.join(refused.withColumnRenamed("position", "ordinal"), "ordinal", "left_anti")
    eval_of = targets.where("type = 'eval'").select(F.col("version_id").alias("to_version_id"), "ns", "name", F.col("record_id").alias("eval_record_id"))
    touched = good.select("version_id", "eval_record_id").distinct()
    old = edges.where(F.col("type") == used_sets.USES).join(eval_of, "to_version_id").select(F.col("from_version_id").alias("version_id"), F.lit(-1).cast("int").alias("ordinal"), "type", "ns", "name", "eval_record_id", "attrs")
    old = used_sets.uses(old.join(touched, ["version_id", "eval_record_id"], "left_semi"))
    # each edge fixes the set with those before it: named runs of all, or live runs as long as none names any
    order = good.withColumn("position", F.col("ordinal")).groupBy("version_id", "eval_record_id").agg(F.min("position").alias("_first"), F.min(F.when(F.col("named").isNotNull(), F.col("position"))).alias("_named"))
    olds = old.groupBy("version_id", "eval_record_id").agg(F.bool_or(F.col("named").isNotNull()).alias("_old_named"))
    whole = order.join(olds, ["version_id", "eval_record_id"], "left").where("not coalesce(_old_named, false) and (_named is null or _first < _named)").select("version_id", "eval_record_id")
    live_runs = runs.where("not archived and not tombstoned").select(F.col("record_id").alias("eval_record_id"), "run_id", "content_hash")
    chosen = used_sets.named_runs(old.unionByName(good)).join(runs.select(F.col("record_id").alias("eval_record_id"), "run_id", "content_hash"), ["eval_record_id", "run_id"])
    more = whole.join(live_runs, "eval_record_id").select("version_id", "eval_record_id", "run_id", "content_hash").unionByName(chosen.select("version_id", "eval_record_id", "run_id", "content_hash")).distinct()
    more = more.join(used.select("version_id", "eval_record_id", "run_id"), ["version_id", "eval_record_id", "run_id"], "left_anti")
    target = F.coalesce(F.col("to_version_id").cast("string"), F.col("to_external"))
    audit = _audit(stored, F.lit("relation.add"), F.col("from_version_id"), F.to_json(F.struct("type", target.alias("to"))))
    return Added(stored, more, lost.unionByName(unknown), audit)
