"""Sharding along a Hilbert curve over quantised metadata.

Language, source and size are quantised to a few bits each and mapped to one curve index; rows sorted by that
index are cut into runs of equal row count, so that each file covers a compact box of all dimensions and a
filter on any of them skips files. Copies of a text take the metadata of the copy with the smallest id, so
equal texts stand next to each other on the curve.

Defined results: null text has size 1 and counts as its own text; null language or source is a value of its
own; repeated rows each get a slot; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, ranked

BITS = 6


def curve_index(coordinates: list[np.ndarray], bits: int) -> np.ndarray:
    """Hilbert index of points with ``bits``-bit coordinates (Skilling's transpose form, then bit interleaving)."""
    x = [np.array(c, np.int64) for c in coordinates]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x = [c ^ flip for c in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | (c >> b & 1)
    return out


def category(column: str, bits: int = BITS) -> Column:
    """A cell for a category; values may share a cell, which costs pruning only."""
    return F.pmod(F.crc32(F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("")).cast("binary")), F.lit(1 << bits)).cast("long")


def magnitude(column: str, bits: int = BITS) -> Column:
    """A cell on a logarithmic scale, three to a doubling."""
    return F.least(F.floor(F.log2(F.greatest(F.col(column), F.lit(1))) * 3), F.lit((1 << bits) - 1)).cast("long")


def _index3(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(curve_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], BITS))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index of every row."""
    text = F.col("text")
    base = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), "lang", "source",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.concat(F.lit("null"), F.col("doc_id").cast("string")), F.lit("null")).alias("text_key"),
        ),
        "hilbert-base",
    )
    first = F.min(F.struct("doc_id", "lang", "source"))
    copies = materialise(base.groupBy("text_key").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "hilbert-copies")
    placed = base.join(copies, "text_key", "left").select(
        "doc_id", "size", "text_crc32", "text_key",
        F.when(F.col("first").isNotNull(), F.col("first.lang")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("first").isNotNull(), F.col("first.source")).otherwise(F.col("source")).alias("source"),
    )
    placed = placed.withColumn("curve", F.pandas_udf(_index3, "long")(category("lang"), category("source"), magnitude("size"))).drop("lang", "source")
    rows, total = ranked(placed, ["curve", "text_key", "doc_id"], "hilbert-order")
    discard(base, copies)
    cut = F.expr(f"rank * {shards} div {max(total, 1)}")
    start = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("_shard", cut).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
