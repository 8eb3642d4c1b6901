"""A JSON text as rows, one per value at any depth, so that rules on it are joins and windows.

The walk itself is the only Python: an Arrow batch of texts is parsed once and leaves as columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Beyond it a double does not hold every integer.
EXACT = 2**53
#: Bodies whose values leave in one batch, which is what a worker holds at once.
BODIES = 64
KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}

NODE = pa.schema([
    ("pointer", pa.string()), ("parent", pa.string()), ("shape", pa.string()), ("parent_shape", pa.string()), ("key", pa.string()), ("in_object", pa.bool_()),
    ("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("number", pa.float64()), ("whole", pa.bool_()), ("large", pa.bool_()), ("size", pa.int32()),
    ("keys", pa.list_(pa.string())), ("given", pa.list_(pa.string())), ("strings", pa.map_(pa.string(), pa.string())), ("counts", pa.map_(pa.string(), pa.float64())), ("sizes", pa.map_(pa.string(), pa.int32())),
])
NODE_DDL = (
    "pointer string, parent string, shape string, parent_shape string, key string, in_object boolean, position int, kind string, text string, number double, whole boolean, large boolean, size int, "
    "keys array<string>, given array<string>, strings map<string,string>, counts map<string,double>, sizes map<string,int>"
)


def escape(key: str) -> str:
    """A key as a token of a JSON Pointer."""
    return key.replace("~", "~0").replace("/", "~1") if "~" in key or "/" in key else key


def is_whole(value) -> bool:
    """A JSON number without a fraction, however it is written."""
    return not isinstance(value, bool) and (isinstance(value, int) or (isinstance(value, float) and value.is_integer()))


def measured(value: float) -> tuple[float, bool, bool]:
    """A JSON number as a double, whether it is whole, and whether it is a whole one that doubles do not hold."""
    whole = is_whole(value)
    try:
        return float(value), whole, whole and abs(value) > EXACT
    except OverflowError:
        return float("inf"), True, True


def nodes_of(text: str | None) -> list[tuple]:
    """All values of a text, parents first; ``invalid`` if it is not JSON. An array's places are ``*`` in a shape."""
    try:
        root = None if text is None else json.loads(text)
    except (ValueError, RecursionError):
        return [("", None, "", None, None, False, None, "invalid", *[None] * 10)]
    out, open_ = [], [(root, "", None, "", None, None, False, None)]
    while open_:
        value, pointer, parent, shape, parent_shape, key, in_object, position = open_.pop()
        kind = KINDS[type(value)]
        keys = given = strings = counts = sizes = size = number = whole = large = None
        if kind == "object":
            keys, given = list(value), [k for k, v in value.items() if v is not None]
            strings = [(k, v) for k, v in value.items() if isinstance(v, str)]
            counts = [(k, float(v)) for k, v in value.items() if isinstance(v, int) and not isinstance(v, bool) and 0 <= v < 1 << 64]
            sizes = [(k, len(v)) for k, v in value.items() if isinstance(v, list)]
            open_ += [(v, f"{pointer}/{escape(k)}", pointer, f"{shape}/{escape(k)}", shape, k, True, i) for i, (k, v) in enumerate(value.items())]
        elif kind == "array":
            size = len(value)
            open_ += [(v, f"{pointer}/{i}", pointer, f"{shape}/*", shape, None, False, i) for i, v in enumerate(value)]
        elif kind == "number":
            number, whole, large = measured(value)
        own = value if kind == "string" else None
        out.append((pointer, parent, shape, parent_shape, key, in_object, position, kind, own, number, whole, large, size, keys, given, strings, counts, sizes))
    return out


def nodes(bodies: DataFrame, column: str = "body") -> DataFrame:
    """The rows of ``bodies`` without the text, repeated for each of its values."""
    rest = [c for c in bodies.columns if c != column]
    kinds = [f"`{c}` {bodies.schema[c].dataType.simpleString()}" for c in rest]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BODIES):
                part = batch.slice(at, BODIES)
                found = [nodes_of(t) for t in part.column(column).to_pylist()]
                where = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
                columns = list(zip(*(n for own in found for n in own)))
                kept = [part.column(c).take(where) for c in rest]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, t) for c, t in zip(columns, NODE.types)], names=[*rest, *NODE.names])

    return bodies.mapInArrow(walk, ", ".join([*kinds, NODE_DDL]))
