"""Relations between versions as a reader may see them: visible edges, resolved targets, and what a body withholds.

An edge (from_version_id, type) points at a version (to_version_id) or at a text (to_external). Targets are versions
with their record's columns (version_id, type, ns, name, seq, visibility, tombstoned, content_hash, address). An edge into
a version that the reader may not see is no row of a search, and a commitment elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from . import filters
from .records import visible


def hub_target(text: Column) -> Column:
    """struct<ns, name, seq> of ``ns/name@seq`` as stored text is read: any digits, seq from 1; null for another form."""
    outside = text.startswith("external:") | text.startswith("hf:")
    right = ~outside & text.rlike(r"\A[^/]+/[^/]+@\+?[0-9]+\z")
    # one slash and no @ behind the last: cut there, without groups of the expression
    ns, rest, digits = F.substring_index(text, "/", 1), F.substring_index(text, "/", -1), F.substring_index(text, "@", -1)
    seq = F.when(right, digits.try_cast("int"))
    return F.when(seq >= 1, F.struct(ns.alias("ns"), F.left(rest, F.length(rest) - F.length(digits) - 1).alias("name"), seq.cast("long").alias("seq")))


def visible_edges(edges: DataFrame, targets: DataFrame, caller: list[str]) -> DataFrame:
    """Edges that a search may match: textual ones, and those into versions the reader may see; ``to`` reads the same for both.

    The two kinds are joined apart, since the null targets of textual edges would meet in one task.
    """
    text = edges.where("to_version_id is null").withColumn("to", F.col("to_external"))
    seen = targets.where(visible(caller)).select(F.col("version_id").alias("to_version_id"), "address")
    resolved = edges.where("to_version_id is not null").join(seen, "to_version_id").withColumn("to", F.coalesce("to_external", "address"))
    columns = [*edges.columns, "to"]
    return text.select(*columns).unionByName(resolved.select(*columns))


def side(edges: DataFrame, targets: DataFrame, caller: list[str], key: str = "version_id") -> filters.Side:
    """What ``any`` searches under ``relations``: type and to."""
    rows = visible_edges(edges, targets, caller).select(F.col("from_version_id").alias(key), "type", "to")
    return filters.Side(rows, key, {"type": filters.Scalar(F.col("type"), "string"), "to": filters.Scalar(F.col("to"), "string")})


def attachment_side(refs: DataFrame, key: str = "version_id") -> filters.Side:
    """What ``any`` searches under ``attachments``: path and sha256 in hex."""
    return filters.Side(refs.select(key, "path", "sha256"), key, {"path": filters.Scalar(F.col("path"), "string"), "sha256": filters.Scalar(F.col("sha256"), "string")})


def resolve(edges: DataFrame, targets: DataFrame, caller: list[str]) -> DataFrame:
    """Each edge as the reader sees it: ``kind`` version, private, unresolved or external, with version_id, address, tombstoned,
    content_hash (of a private one alone) and text.

    A textual address is tried again at each read and finds visible versions only, of a card and an eval by one name the
    card; so it never tells that a private version exists.
    """
    keys = edges.columns
    # each lookup takes all edges along, those that ask nothing spread, since their nulls would meet in one task
    spread = F.xxhash64("from_version_id", "to_version_id", "to_external")
    seen = visible(caller)
    open_ = lambda c: F.when(seen, F.col(c)).alias(c)
    own = targets.select(F.col("version_id").alias("_id"), F.struct("version_id", seen.alias("seen"), open_("address"), open_("tombstoned"), F.when(~seen, F.col("content_hash")).alias("content_hash")).alias("_own"))
    by_id = edges.withColumn("_asked", F.coalesce("to_version_id", spread)).join(own, (F.col("_asked") == F.col("_id")) & F.col("to_version_id").isNotNull(), "left")
    text = F.coalesce("to_external", F.lit(""))
    lost = by_id.select(*keys, "_own", F.when(F.col("_own").isNull(), text).alias("_text")).withColumn("_t", hub_target(F.col("_text")))
    # by a number first: rows are sorted for the join, and names of one namespace begin alike
    number = lambda seq: F.xxhash64("ns", "name", F.col(seq).cast("long"))
    first = targets.where(seen).withColumn("_n", number("seq")).groupBy("_n", "ns", "name", "seq").agg(F.min_by(F.struct("version_id", "address", "tombstoned"), "type").alias("_v"))
    asked = lost.select(*keys, "_own", "_text", spread.alias("_spread"), "_t.ns", "_t.name", "_t.seq").withColumn("_n", F.when(F.col("seq").isNotNull(), number("seq")).otherwise(F.col("_spread")))
    both = asked.drop("_spread").join(first, ["_n", "ns", "name", "seq"], "left")
    there, lazy = F.col("_own").isNotNull(), F.col("_v").isNotNull()
    outside = F.col("_text").startswith("external:") | F.col("_text").startswith("hf:")
    mine = lambda c: F.when(there, F.col(f"_own.{c}")).otherwise(F.col(f"_v.{c}")).alias(c)
    return both.select(
        *keys, F.when(there, F.when(F.col("_own.seen"), "version").otherwise("private")).when(lazy, "version").when(F.col("seq").isNull() & outside, "external").otherwise("unresolved").alias("kind"),
        mine("version_id"), mine("address"), mine("tombstoned"), F.col("_own.content_hash").alias("content_hash"), F.when(~there & ~lazy, F.col("_text")).alias("text"),
    )


def resolve_written(refs: DataFrame, targets: DataFrame, writer: list[str], type_: str | None = None) -> DataFrame:
    """The version that a written reference (``text``) is stored as: the one visible match, of a type if that is given; null for none
    or several."""
    there = targets.where(visible(writer))
    there = there.where(F.col("type") == type_) if type_ else there
    one = there.groupBy("ns", "name", "seq").agg(F.count("*").alias("matches"), F.min("version_id").alias("resolved")).where("matches = 1").drop("matches")
    asked = refs.withColumn("_t", hub_target(F.col("text")))
    joined = asked.where("_t is not null").select("*", "_t.*").join(one, ["ns", "name", "seq"], "left").select(*refs.columns, "resolved")
    return joined.unionByName(asked.where("_t is null").select(*refs.columns, F.lit(None).cast("long").alias("resolved")))


def hidden_targets(edges: DataFrame, targets: DataFrame, caller: list[str]) -> DataFrame:
    """Resolved targets that the reader may not see: from_version_id, relation, ns, name, seq, version_id, content_hash."""
    unseen = targets.where(~visible(caller)).select("ns", "name", "seq", "version_id", "content_hash")
    return edges.where("to_version_id is not null").join(unseen, F.col("to_version_id") == F.col("version_id")).select("from_version_id", F.col("type").alias("relation"), *unseen.columns)


def hidden_evals(judged: DataFrame, records: DataFrame, caller: list[str]) -> DataFrame:
    """Evals that the reader may not see, with how many judgements a version has of their runs."""
    unseen = records.where(~visible(caller)).select(F.col("record_id").alias("eval_record_id"), "ns", "name")
    return judged.groupBy("version_id", "eval_record_id").agg(F.count("*").alias("judgements")).join(unseen, "eval_record_id")


def _texts(elements: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(elements, lambda x: F.to_json(x)), ","), F.lit("]"))


def withhold(bodies: DataFrame, hidden: DataFrame, evals: DataFrame) -> DataFrame:
    """Bodies (version_id, body) without what the reader may not see, in canonical form, and what went.

    ``relations`` elements that name a hidden target of the version's own, by type and parsed address, are reported as
    commitments in body order; ``run_results`` elements of a hidden eval as a number alone. Bodies with neither stay as they
    are. What is hidden from a body is joined to it once, by version; its elements are then looked up in place.
    """
    parts = ["relation", "ns", "name", "seq"]
    commitment = F.min(F.struct(F.col("version_id").alias("id"), "content_hash")).alias("c")
    named = hidden.dropna(subset=parts).groupBy("from_version_id", *parts).agg(commitment)
    entry = F.struct(F.struct(F.col("relation").alias("type"), "ns", "name", F.col("seq").cast("long").alias("seq")).alias("key"), F.col("c").alias("value"))
    gone = named.groupBy(F.col("from_version_id").alias("version_id")).agg(F.map_from_entries(F.collect_list(entry)).alias("gone"))
    judged = evals.groupBy("version_id").agg(F.collect_set(F.concat("ns", F.lit("/"), "name")).alias("out"))
    rows = bodies.join(gone, "version_id", "left").join(judged, "version_id", "left")
    rows = rows.withColumn("v", F.when(F.col("gone").isNotNull() | F.col("out").isNotNull(), F.parse_json("body")))

    def edge(x: Column) -> Column:
        kind, t = F.try_variant_get(x, "$.type", "string"), hub_target(F.try_variant_get(x, "$.to", "string"))
        return F.struct(kind.alias("type"), F.try_element_at("gone", F.struct(kind.alias("type"), t["ns"].alias("ns"), t["name"].alias("name"), t["seq"].alias("seq"))).alias("c"), x.alias("element"))

    def verdict(x: Column) -> Column:
        return F.struct(F.coalesce(F.array_contains("out", F.try_variant_get(x, "$.eval", "string")), F.lit(False)).alias("c"), x.alias("element"))

    elements = lambda k: F.try_variant_get("v", f"$.{k}", "array<variant>")
    rows = rows.withColumn("edges", F.when(F.col("gone").isNotNull(), F.transform(elements("relations"), edge))).withColumn("verdicts", F.when(F.col("out").isNotNull(), F.transform(elements("run_results"), verdict)))
    commit = lambda x: F.struct(x["type"].alias("type"), x["c"]["id"].alias("version_id"), x["c"]["content_hash"].alias("content_hash"))
    removed = F.coalesce(F.transform(F.filter("edges", lambda x: x["c"].isNotNull()), commit), F.array().cast("array<struct<type:string,version_id:bigint,content_hash:string>>"))
    rows = rows.withColumn("withheld_relations", removed).withColumn("withheld_run_results", F.coalesce(F.when(F.col("verdicts").isNotNull(), F.size(F.filter("verdicts", lambda x: x["c"]))), F.lit(0)).cast("long"))
    some, fewer = F.size("withheld_relations") > 0, F.col("withheld_run_results") > 0
    new_edges = _texts(F.transform(F.filter("edges", lambda x: x["c"].isNull()), lambda x: x["element"]))
    new_verdicts = _texts(F.transform(F.filter("verdicts", lambda x: ~x["c"]), lambda x: x["element"]))
    quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"\A\[|\]\z", "")
    value = lambda x: F.when((x["key"] == "relations") & F.col("some"), F.col("new_edges")).when((x["key"] == "run_results") & F.col("fewer"), F.col("new_verdicts")).otherwise(F.to_json(x["value"]))
    rows = rows.withColumns({"some": some, "fewer": fewer, "new_edges": F.when(some, new_edges), "new_verdicts": F.when(fewer, new_verdicts)})
    whole = F.map_entries(F.variant_get("v", "$", "map<string,variant>"))
    rebuilt = F.when(F.col("some") | F.col("fewer"), F.concat(F.lit("{"), F.array_join(F.transform(whole, lambda x: F.concat(quoted(x["key"]), F.lit(":"), value(x))), ","), F.lit("}")))
    went = lambda n: F.when(F.col("some") | F.col("fewer"), F.col(n)).alias(n)
    done = rows.select("version_id", "body", rebuilt.alias("new"), went("withheld_relations"), went("withheld_run_results"))
    return done.select("version_id", F.coalesce(canon.canonical_json(F.col("new")), "body").alias("body"), "withheld_relations", "withheld_run_results")
