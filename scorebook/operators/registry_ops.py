"""Small operators on records, the registry, badges and objects: lookups, immutable puts, states, uploads and their sweep."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import visible


def address(text: str) -> tuple[str, str, str | int | None]:
    """(kind, name, what follows @): ``latest``, ``seq`` for digits alone, else ``label``."""
    name, at, rest = text.partition("@")
    if not at:
        return "latest", name, None
    if re.fullmatch(r"[0-9]+", rest):
        return "seq", name, int(rest)
    return "label", name, rest


def addressed(asked: Column) -> Column:
    """struct<kind, name, seq, label> of ``name``, ``name@seq`` or ``name@label``; digits that are no number name nothing."""
    name, rest = F.regexp_extract(asked, r"\A([^@]*)", 1), F.regexp_extract(asked, r"(?s)\A[^@]*@(.*)\z", 1)
    kind = F.when(~F.contains(asked, F.lit("@")), "latest").when(rest.rlike(r"\A[0-9]+\z"), "seq").otherwise("label")
    return F.struct(kind.alias("kind"), name.alias("name"), F.when(kind == "seq", rest.try_cast("int")).alias("seq"), F.when(kind == "label", rest).alias("label"))


def lookup(asked: DataFrame, records: DataFrame, versions: DataFrame, caller: list[str]) -> DataFrame:
    """The version that each address (type, ns, address) names for the reader, with address; tombstoned ones by number or label only.

    versions: version_id, record_id, seq, label, tombstoned.
    """
    parts = asked.withColumn("a", addressed(F.col("address"))).select("type", "ns", "address", "a.*")
    there = parts.join(records.where(visible(caller)).select("record_id", "type", "ns", "name"), ["type", "ns", "name"])
    last = versions.where(~F.col("tombstoned")).groupBy("record_id").agg(F.max_by(F.struct("version_id", "seq", "tombstoned"), "seq").alias("v")).select("record_id", "v.*")
    own = ["type", "ns", "address", "version_id", "seq", "tombstoned"]
    found = there.where("kind = 'latest'").drop("seq").join(last, "record_id").select(*own)
    every = versions.select("record_id", "seq", "version_id", "tombstoned", "label")
    by_seq = there.where("kind = 'seq'").drop("label").join(every.drop("label"), ["record_id", "seq"]).select(*own)
    by_label = there.where("kind = 'label'").drop("seq").join(every, ["record_id", "label"]).select(*own)
    return found.unionByName(by_seq).unionByName(by_label)


# --- registry: kind, ns, id, version, state


def put_entries(registry: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the registry with the entries, what is refused with why). Entries are immutable, ``core`` is read-only, schemas of
    extensions start ``applying``. Of equal new ones the one of the lowest position counts and the others exist.

    new: position, kind, ns, id, version.
    """
    key = ["kind", "ns", "id", "version"]
    first = new.where("ns <> 'core'").groupBy(*key).agg(F.min("position").alias("position"))
    fresh = first.join(registry.select(*key), key, "left_anti")
    state = F.when(F.col("kind") == "ext_schemas", "applying").otherwise("applied")
    refused = new.join(fresh.select(*key, "position"), [*key, "position"], "left_anti")
    why = F.when(F.col("ns") == "core", "core_read_only").otherwise("registry_entry_exists")
    return registry.unionByName(fresh.select(*key, state.alias("state"))), refused.select("position", *key, why.alias("code"))


def set_state(registry: DataFrame, flips: DataFrame) -> DataFrame:
    """The registry with the states of the flips (kind, ns, id, version, state)."""
    key = ["kind", "ns", "id", "version"]
    return registry.join(flips.withColumnRenamed("state", "_state"), key, "left").select(*key, F.coalesce("_state", "state").alias("state"))


def listed(registry: DataFrame, kind: str | None = None, ns: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of entries in order of kind, ns, id and version."""
    rows = registry.where(F.col("kind") == kind) if kind is not None else registry
    rows = rows.where(F.col("ns") == ns) if ns is not None else rows
    return rows.orderBy("kind", "ns", "id", "version").offset(offset).limit(max(1, limit))


def set_badges(versions: DataFrame, new: DataFrame) -> DataFrame:
    """The versions with the badges of ``new`` (version_id, badges) where there are some; an empty list is one."""
    return versions.join(new.select("version_id", F.col("badges").alias("_badges")), "version_id", "left").withColumn("badges", F.coalesce("_badges", "badges")).drop("_badges")


# --- objects: sha256, size, media_type, state, hashed, created_at


def announce(objects: DataFrame, uploads: DataFrame) -> DataFrame:
    """The objects with the announced ones (position, sha256, size, media_type, created_at), in order of position.

    A pending object takes the last size and the last media type that is given; a ready one stays as it is.
    """
    given = F.col("media_type").isNotNull()
    last = uploads.groupBy("sha256").agg(F.max_by("size", "position").alias("_size"), F.max_by("media_type", F.when(given, F.col("position"))).alias("_type"), F.min("created_at").alias("_at"))
    both = objects.join(last, "sha256", "full_outer")
    open_ = F.coalesce(F.col("state"), F.lit("pending")) == "pending"
    return both.select(
        "sha256", F.when(open_, F.coalesce("_size", "size")).otherwise(F.col("size")).alias("size"), F.when(open_, F.coalesce("_type", "media_type")).otherwise(F.col("media_type")).alias("media_type"),
        F.coalesce("state", F.lit("pending")).alias("state"), F.coalesce("hashed", F.lit(False)).alias("hashed"), F.coalesce("created_at", "_at").alias("created_at"),
    )


def complete(objects: DataFrame, stored: DataFrame, most_hashed: int) -> tuple[DataFrame, DataFrame]:
    """(the objects, refusals): those that are in the store (sha256, actual, digest) with the announced size become ready.

    Up to ``most_hashed`` bytes the digest must be the name; larger ones are taken by size and marked as not hashed.
    """
    small = F.col("actual") <= most_hashed
    code = F.when(F.col("size").isNull(), "attachment_unknown").when(F.col("actual") != F.col("size"), "object_size_mismatch").when(small & (F.col("digest") != F.col("sha256")), "object_hash_mismatch")
    checked = stored.join(objects.select("sha256", "size"), "sha256", "left").withColumn("code", code)
    good = checked.where("code is null").select("sha256", small.alias("_hashed"))
    rows = objects.join(good, "sha256", "left").withColumn("state", F.when(F.col("_hashed").isNotNull(), "ready").otherwise(F.col("state"))).withColumn("hashed", F.coalesce("_hashed", "hashed")).drop("_hashed")
    return rows, checked.where("code is not null").select("sha256", "code")


def sweep(objects: DataFrame, candidates: DataFrame, *refs: DataFrame) -> DataFrame:
    """The second phase of the sweep: objects without the candidates of the first that still have no reference now."""
    gone = candidates.select("sha256").distinct()
    for r in refs:
        gone = gone.join(r.select("sha256"), "sha256", "left_anti")
    return objects.join(gone, "sha256", "left_anti")
