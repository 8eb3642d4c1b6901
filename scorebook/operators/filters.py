"""Filters given as JSON, applied to a DataFrame.

    filter := {"and": [filter...]} | {"or": [filter...]} | {"not": filter}
            | {"path", "op", "value"} | {"path", "op": "exists"} | {"path", "op": "any", "match": {key: value | {"op", "value"}}}

A vocabulary names the paths: scalar columns, side tables that ``any`` searches, and keyed facts (such as
fingerprints) of which a row may have none. Comparisons follow SQL's three values, so a row whose operand is
null passes neither a comparison nor its negation. Conditions on side tables become semi or anti joins where they
stand alone in the conjunction, and existence flags elsewhere.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operators that each type admits, and those of a path without a column of its own.
ANY_TYPE = {"eq", "ne", "in", "exists"}
SUITS = {
    "number": ANY_TYPE | {"gt", "gte", "lt", "lte"},
    "string": ANY_TYPE | {"gt", "gte", "lt", "lte", "prefix", "contains"},
    "boolean": ANY_TYPE,
    "timestamp": ANY_TYPE | {"gt", "gte", "lt", "lte"},
}
UNINDEXED = {"eq", "exists"}
PYTHON = {"number": (int, float), "string": (str,), "boolean": (bool,), "timestamp": (str,)}


class FilterError(ValueError):
    """code: unknown_path, type_mismatch, not_indexed or bad_request, at a JSON pointer."""

    def __init__(self, pointer: str, code: str):
        super().__init__(f"{pointer}: {code}")
        self.pointer, self.code = pointer, code


@dataclass
class Scalar:
    column: Column
    type: str
    indexed: bool = True


@dataclass
class Side:
    """Rows that ``any`` searches: joined on key."""

    rows: DataFrame
    key: str
    fields: dict[str, Scalar]


@dataclass
class Fact:
    """At most one value per key; ``ne`` holds where there is none."""

    rows: DataFrame
    key: str
    value: str


@dataclass
class Vocabulary:
    scalars: dict[str, Scalar] = field(default_factory=dict)
    sides: dict[str, Side] = field(default_factory=dict)
    facts: dict[str, Fact] = field(default_factory=dict)


def shape(f, at: str) -> None:
    """Refuse what is no filter: another type, several words at once, keys that a leaf does not have."""
    words = {"and", "or", "not"} & set(f) if isinstance(f, dict) else {None}
    if words:
        if len(words) > 1 or not isinstance(f, dict) or len(f) > 1 or (words & {"and", "or"} and not isinstance(next(iter(f.values())), list)):
            raise FilterError(at, "bad_request")
        return
    path, op = f.get("path"), f.get("op")
    more = {"any": {"match"}, "exists": set()}.get(op, {"value"}) if isinstance(op, str) else None
    if more is None or not isinstance(path, str) or set(f) != {"path", "op"} | more:
        raise FilterError(at, "bad_request")


def _literal(value, type_: str, at: str):
    fits = isinstance(value, PYTHON[type_]) and (type_ == "boolean" or not isinstance(value, bool))
    if not fits:
        raise FilterError(at, "type_mismatch")
    if type_ == "timestamp":
        try:
            moment = dt.datetime.fromisoformat(value.upper().replace("Z", "+00:00"))
        except ValueError:
            raise FilterError(at, "type_mismatch") from None
        if moment.tzinfo is None or "T" not in value.upper():
            raise FilterError(at, "type_mismatch")
        return F.lit(moment)
    return F.lit(float(value)) if type_ == "number" else F.lit(value)


def compare(s: Scalar, op: str, value, at: str) -> Column:
    if op not in SUITS[s.type]:
        raise FilterError(at, "type_mismatch" if any(op in x for x in SUITS.values()) else "bad_request")
    if not s.indexed and op not in UNINDEXED:
        raise FilterError(at, "not_indexed")
    c = s.column
    if op == "exists":
        return c.isNotNull()
    if op == "in":
        if not isinstance(value, list):
            raise FilterError(at, "type_mismatch")
        return c.isin([_literal(v, s.type, at) for v in value]) if value else F.lit(False)
    v = _literal(value, s.type, at)
    return {
        "eq": lambda: c == v, "ne": lambda: c != v, "gt": lambda: c > v, "gte": lambda: c >= v,
        "lt": lambda: c < v, "lte": lambda: c <= v, "prefix": lambda: c.startswith(v), "contains": lambda: c.contains(v),
    }[op]()


def _matching(leaf: dict, side: Side, at: str) -> DataFrame:
    """Keys of the side rows that satisfy all terms at once."""
    terms = []
    if not isinstance(leaf["match"], dict):
        raise FilterError(f"{at}/match", "bad_request")
    for key, term in leaf["match"].items():
        if isinstance(term, (list, type(None))) or (isinstance(term, dict) and not {"value"} <= set(term) <= {"op", "value"} and term != {"op": "exists"}):
            raise FilterError(f"{at}/match/{key}", "bad_request")
        if key not in side.fields:
            raise FilterError(f"{at}/match/{key}", "unknown_path")
        op, value = (term.get("op", "eq"), term.get("value")) if isinstance(term, dict) else ("eq", term)
        terms.append(compare(side.fields[key], op, value, f"{at}/match/{key}"))
    if not terms:
        raise FilterError(at, "bad_request")
    return side.rows.where(reduce(lambda a, b: a & b, terms)).select(side.key).distinct()


class _Compiler:
    def __init__(self, df: DataFrame, words: Vocabulary):
        self.df, self.words, self.flags = df, words, []

    def flag(self, keys: DataFrame, key: str) -> Column:
        name = f"_flag{len(self.flags)}"
        self.flags.append(name)
        self.df = self.df.join(keys.withColumn(name, F.lit(True)), key, "left")
        return F.coalesce(F.col(name), F.lit(False))

    def keys(self, f: dict, at: str) -> tuple[DataFrame, str, bool] | None:
        """(keys, key column, whether a row must not have it) of a condition on another table."""
        path, op = f.get("path"), f.get("op")
        if path in self.words.sides:
            if op != "any":
                raise FilterError(at, "type_mismatch")
            side = self.words.sides[path]
            return _matching(f, side, at), side.key, False
        if path in self.words.facts:
            fact = self.words.facts[path]
            if op not in ANY_TYPE:
                raise FilterError(at, "not_indexed")
            rows = fact.rows if op == "exists" else fact.rows.where(compare(Scalar(F.col(fact.value), "string"), "eq" if op == "ne" else op, f.get("value"), at))
            return rows.select(fact.key).distinct(), fact.key, op == "ne"
        return None

    def column(self, f: dict, at: str) -> Column:
        shape(f, at)
        for word in ("and", "or"):
            if word in f:
                parts = [self.column(x, f"{at}/{word}/{i}") for i, x in enumerate(f[word])]
                return reduce(lambda a, b: a & b if word == "and" else a | b, parts, F.lit(word == "and"))
        if "not" in f:
            return ~self.column(f["not"], f"{at}/not")
        found = self.keys(f, at)
        if found:
            keys, key, absent = found
            flag = self.flag(keys, key)
            return ~flag if absent else flag
        if f["path"] not in self.words.scalars:
            raise FilterError(at, "unknown_path")
        if f["op"] == "any":
            raise FilterError(at, "type_mismatch")
        return compare(self.words.scalars[f["path"]], f["op"], f.get("value"), at)


def apply(df: DataFrame, where: dict | None, words: Vocabulary) -> DataFrame:
    """The rows of df that pass; its columns as they were."""
    if where is None or where == {}:
        return df
    shape(where, "/where")
    made, columns = _Compiler(df, words), df.columns
    conjuncts = where["and"] if "and" in where else [where]
    rest = []
    for i, f in enumerate(conjuncts):
        at = f"/where/and/{i}" if "and" in where else "/where"
        shape(f, at)
        found = made.keys(f, at) if "path" in f else None
        if found:
            keys, key, absent = found
            made.df = made.df.join(keys, key, "left_anti" if absent else "left_semi")
        else:
            rest.append(made.column(f, at))
    out = made.df
    return (out.where(reduce(lambda a, b: a & b, rest)) if rest else out).select(*columns)
