"""Identifiers, addresses and timestamps as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower-case letters, digits and . _ - after a letter or digit.
_SLUG = "[a-z0-9][a-z0-9._-]*"


def is_id(c: Column) -> Column:
    """ns/name, both slugs."""
    return c.rlike(rf"\A{_SLUG}/{_SLUG}\z")


def is_run_id(c: Column) -> Column:
    return (F.octet_length(c) > 0) & (F.octet_length(c) <= 200) & ~F.contains(c, F.lit("/"))


def address(ns: Column, name: Column, seq: Column) -> Column:
    return F.concat(ns, F.lit("/"), name, F.lit("@"), seq.cast("string"))


def parsed_target(c: Column) -> Column:
    """struct<kind, ns, name, seq>: external, hf, version, or null kind if it is none of these; nothing after a colon is none."""
    m = rf"\A({_SLUG})/({_SLUG})@([0-9]+)\z"
    seq = F.when(c.rlike(m), F.regexp_extract(c, m, 3).try_cast("decimal(38,0)"))
    kind = F.when(c.rlike(r"(?s)\Aexternal:."), "external").when(c.rlike(r"(?s)\Ahf:."), "hf").when((seq >= 1) & (seq <= 4294967295), "version")
    pick = lambda i: F.when(kind == "version", F.regexp_extract(c, m, i))
    return F.struct(kind.alias("kind"), pick(1).alias("ns"), pick(2).alias("name"), F.when(kind == "version", seq.cast("long")).alias("seq"))


def instant(c: Column) -> Column:
    """An RFC 3339 time, with T and an offset; null otherwise."""
    form = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\z"
    return F.when(c.rlike(form), F.try_to_timestamp(F.upper(c)))


def unhex_strict(c: Column) -> Column:
    """Bytes of lower-case hex; null if it is anything else."""
    return F.when(c.rlike(r"\A([0-9a-f]{2})*\z"), F.unhex(c))
