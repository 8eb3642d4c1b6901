"""Helpers shared by the training-data operators: documents, shared scratch tables, word rules."""

from __future__ import annotations

import base64
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and \t \n \v \f \r, the set that ``bytes.split()`` uses too.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of this process's own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialise() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def settle(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more; Spark does so when the driver collects garbage."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)  # what Python drops, a thread of the gateway tells the driver a little later
        spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts: keep an Arrow batch to a bounded number of rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary").alias(column)


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def batches(schema: pa.Schema, rows: list[tuple]):
    """One record batch from row tuples, none if there are no rows."""
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed; ascending 64-bit ones as differences."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unpack(packed: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    values = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=np.uint64) if kind == np.uint64 else values


def offsets_of(df: DataFrame, name: str, column: str = "rank") -> tuple[DataFrame, int]:
    """Write df once; ``column`` numbers its rows from 0 in order of partition and place. Also their number.

    Only the partitions' row counts meet on the driver.
    """
    written = materialise(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = written.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["_part"], total))
        total += r["n"]
    if not offsets:
        return written.withColumn(column, F.lit(0).cast("long")).drop("_at"), 0
    starts = F.create_map([F.lit(x) for pair in offsets for x in pair])
    rank = starts[part] + F.col("_at").bitwiseAND((1 << 33) - 1)
    return written.withColumn(column, rank.cast("long")).drop("_at"), total


def ranked(df: DataFrame, keys: list, name: str) -> tuple[DataFrame, int]:
    """The rows with a dense global ``rank`` from 0 in order of the keys, and their number."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return offsets_of(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys), name)


_encodings: dict[tuple[str, str], object] = {}


def tiktoken_encoding(path: str, pattern: str):
    """The vocabulary of a ranks file, read once per worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]
