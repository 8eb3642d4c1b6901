"""Ordering with explicit null placement, and keyset pages.

Ascending keys put nulls last, descending ones first. The last key's direction also orders the tie-break.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST, USUAL = 1, 200, 50


def parse_sort(text: str) -> tuple[str, str]:
    """path[:asc|:desc]; only the last colon counts."""
    path, _, direction = text.rpartition(":")
    return (path, direction) if path and direction in ("asc", "desc") else (text, "asc")


def with_tie(sort: list[tuple[str, str]], tie: str, default: list[tuple[str, str]]) -> list[tuple[str, str]]:
    keys = sort or default
    return [*keys, (tie, keys[-1][1])] if keys and keys[-1][0] != tie else keys


def ordering(sort: list[tuple[str, str]]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_first() for c, d in sort]


def _after(c: str, direction: str, value) -> Column:
    """Rows that come strictly after the value in the key's order, nulls placed."""
    column = F.col(c)
    if direction == "asc":
        return F.lit(False) if value is None else (column > F.lit(value)) | column.isNull()
    return column.isNotNull() if value is None else column < F.lit(value)


def after(sort: list[tuple[str, str]], cursor: list, drop_nulls: bool = False) -> Column:
    """The lexicographic predicate for rows after the cursor's key values.

    ``drop_nulls`` is the record search's rule: once a cursor is present, rows with a null key are gone.
    """
    terms = []
    for i, (c, d) in enumerate(sort):
        same = [F.col(k).eqNullSafe(F.lit(v)) for (k, _), v in zip(sort[:i], cursor)]
        terms.append(reduce(lambda a, b: a & b, [*same, _after(c, d, cursor[i])]))
    found = reduce(lambda a, b: a | b, terms)
    if drop_nulls:
        found = found & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c, _ in sort])
    return found


def page(df: DataFrame, sort: list[tuple[str, str]], limit: int = USUAL, cursor: list | None = None, drop_nulls: bool = False) -> DataFrame:
    """One page and one row more, which tells that there is a next page."""
    if cursor is not None:
        df = df.where(after(sort, cursor, drop_nulls))
    return df.orderBy(*ordering(sort)).limit(max(LEAST, min(MOST, limit)) + 1)


def sign(payload, secret: bytes) -> str:
    raw = json.dumps(payload, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw + hmac.digest(secret, raw, hashlib.sha256)).decode().rstrip("=")


def verify(cursor: str, secret: bytes):
    """The payload, or ValueError if it was changed."""
    data = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
    raw, mac = data[:-32], data[-32:]
    if not hmac.compare_digest(mac, hmac.digest(secret, raw, hashlib.sha256)):
        raise ValueError("bad cursor")
    return json.loads(raw)
