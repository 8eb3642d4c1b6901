"""Canonical JSON (RFC 8785), content hashes, facet fingerprints and set hashes."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The facets of a body, and the keys that a fingerprint leaves out (ext in every facet).
FACETS = ["model", "task", "harness", "generation", "trial", "grading", "env"]
NOTHING = hashlib.sha256(b"{}").hexdigest()
EXCLUDED = {"model": {"context_window"}, "env": {"os", "hardware"}}


def number(x: float) -> str:
    """A double as ECMAScript prints it."""
    if isinstance(x, int) and abs(x) <= 2**53:
        return str(x)
    x = float(x)
    if math.isnan(x) or math.isinf(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    digits, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    e = int(exponent or 0)
    point = len(whole) + e
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(digits)
    digits = digits.rstrip("0")
    n = len(digits)
    sign = "-" if x < 0 else ""
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    power = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + digits[0] + ("." + digits[1:] if n > 1 else "") + power


_quoted = json.encoder.encode_basestring


def canonical(value) -> str:
    """Keys in order of their UTF-16 units, no spaces, least escapes."""
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, dict):
        keys = sorted(value) if all(map(str.isascii, value)) else sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join([_quoted(k) + ":" + canonical(value[k]) for k in keys]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    return number(value)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def facet_hash(body: dict, facet: str) -> str:
    """An absent or null facet counts as {}."""
    own = body.get(facet) or {}
    kept = {k: v for k, v in own.items() if k != "ext" and k not in EXCLUDED.get(facet, ())}
    if not kept:
        return NOTHING
    return hashlib.sha256(canonical(kept).encode()).hexdigest()


def canonical_json(body: Column) -> Column:
    """JSON text in canonical form, per Arrow batch; null stays null."""

    def form(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else canonical(json.loads(b)))

    return F.pandas_udf(form, "string")(body)


def content_hash(body: Column) -> Column:
    return F.sha2(canonical_json(body), 256)


def fingerprints(body: Column) -> Column:
    """array<struct<facet, fingerprint>> over all facets."""

    def prints(bodies: pd.Series) -> pd.Series:
        whole = bodies.map(lambda b: None if b is None else json.loads(b))
        return whole.map(lambda b: None if b is None else [{"facet": f, "fingerprint": facet_hash(b, f)} for f in FACETS])

    return F.pandas_udf(prints, "array<struct<facet:string,fingerprint:string>>")(body)


def set_hashes(rows: DataFrame, by: str, run_id: str, *digests: str) -> DataFrame:
    """``by`` and per column of digests the sha256 of [[run_id, hex], ...] of its set, in order of the id's bytes.

    A set's rows are sorted into one task and run through the digest as they come, so no set is ever held whole, of whatever
    size. Null ids are not counted; sets without rows are not returned (theirs is the hash of []).
    """
    kind = rows.schema[by].dataType.simpleString()
    chosen = rows.where(F.col(run_id).isNotNull()).select(by, run_id, *digests).repartition(by).sortWithinPartitions(by, run_id, *digests)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashes = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if hashes:
                for h in hashes:
                    h.update(b"]")
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], key), *(pa.array([h.hexdigest()]) for h in hashes)], names=[by, *digests])

        for batch in batches:
            key = batch.column(0).type
            sets, names = batch.column(0).to_pylist(), [canonical(i) for i in batch.column(1).to_pylist()]
            values = [batch.column(2 + k).to_pylist() for k in range(len(digests))]
            starts = [i for i in range(len(sets)) if i == 0 or sets[i] != sets[i - 1]]
            for at, to in zip(starts, [*starts[1:], len(sets)]):
                first = now != (sets[at],)
                if first:
                    yield from done()
                    now, hashes = (sets[at],), [hashlib.sha256(b"[") for _ in digests]
                for h, own in zip(hashes, values):
                    text = ",".join(f'[{n},"{v}"]' for n, v in zip(names[at:to], own[at:to]))
                    h.update((text if first else "," + text).encode())
        yield from done()

    return chosen.mapInArrow(stream, f"`{by}` {kind}, " + ", ".join(f"`{d}` string" for d in digests))
