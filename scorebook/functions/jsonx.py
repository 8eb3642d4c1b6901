"""Strict typed reads of JSON held as VARIANT, existence, and containment.

A read never casts: the wrong JSON type gives null, as does an absent key or a JSON null.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def path(*segments: str) -> str:
    """A quoted path; segments may hold any character but control characters."""
    for s in segments:
        if not s or any(ord(c) < 32 for c in s):
            raise ValueError(f"not a path segment: {s!r}")
    return "$" + "".join('["' + s.replace("\\", "\\\\").replace('"', '\\"') + '"]' for s in segments)


def parsed(body: Column) -> Column:
    """The JSON text as VARIANT; null if it is not JSON."""
    return F.try_parse_json(body)


def _at(v: Column, p: str) -> Column:
    return F.variant_get(v, p, "variant")


def _typed(v: Column, p: str, kinds: str, spark_type: str) -> Column:
    found = _at(v, p)
    return F.when(F.schema_of_variant(found).rlike(f"^({kinds})"), F.try_variant_get(found, "$", spark_type))


def json_num(v: Column, p: str) -> Column:
    return _typed(v, p, "BIGINT|DECIMAL|DOUBLE|FLOAT", "double")


def json_str(v: Column, p: str) -> Column:
    return _typed(v, p, "STRING", "string")


def json_bool(v: Column, p: str) -> Column:
    return _typed(v, p, "BOOLEAN", "boolean")


def exists(v: Column, p: str) -> Column:
    """Whether the key is there; a JSON null is."""
    return _at(v, p).isNotNull()


def is_null(v: Column, p: str) -> Column:
    """Whether the key is there and holds a JSON null."""
    return F.coalesce(F.is_variant_null(_at(v, p)), F.lit(False))


def nested(segments: list[str], value):
    """The value under the path: ["a", "b"], 1 gives {"a": {"b": 1}}."""
    for s in reversed(segments):
        value = {s: value}
    return value


def holds(whole, part) -> bool:
    """JSON containment: objects by key, arrays by element, scalars by type and value (4 is 4.0, true is not 1)."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and holds(whole[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(holds(w, p) for w in whole) for p in part)
    return isinstance(whole, bool) == isinstance(part, bool) and not isinstance(whole, (dict, list)) and whole == part


def contains(body: Column, part) -> Column:
    """Whether JSON text contains the object or array. Scalars under a path need no Python: see ``equals``."""

    def test(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else holds(json.loads(b), part))

    return F.pandas_udf(test, "boolean")(body)


def equals(v: Column, p: str, literal) -> Column:
    """Containment of a scalar at a path, as typed comparison."""
    if literal is None:
        return is_null(v, p)
    if isinstance(literal, bool):
        return F.coalesce(json_bool(v, p) == literal, F.lit(False))
    if isinstance(literal, (int, float)):
        return F.coalesce(json_num(v, p) == float(literal), F.lit(False))
    return F.coalesce(json_str(v, p) == literal, F.lit(False))
