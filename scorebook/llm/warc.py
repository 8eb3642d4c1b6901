"""WARC archives written and read on Spark, and an external merge of their sorted capture indexes.

``write`` turns rows into WARC/1.1 records with DataFrame functions alone; Spark's text writer ends each
record with the blank lines that the format asks for, so part files are archives. ``read_index`` frames the
records of each archive by Content-Length and yields one locally sorted capture run per archive. ``merge``
deals the runs out by key range and merges, per range, the k runs with a loser tree by URL key, timestamp
and id, which gives globally ordered capture histories.

Defined results: a null payload is empty; a null URL has the empty key; control characters and spaces in a
URL are written as %20; records with payloads under ``min_bytes`` are never revisits; of equal payloads each
row with the smallest id is a response; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, offsets_of, small_batches

MIN_BYTES = 100
END = "\r\n\r\n"
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", re.S)

RUN = pa.schema([
    ("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()), ("time", pa.string()), ("page_id", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
DDL = "run string, seq long, url_key string, time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path and query: com,example)/a?b=c."""
    if not url:
        return ""
    m = URL.match(url)
    if not m:
        return url
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, start: str = "2024-01-01 00:00:00") -> None:
    """Write a record per row (page_id, url, html). Capture times are ``start`` plus page_id seconds."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("html"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    digests = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Only digests that occur twice matter. Written first, so that both join sides are plain shuffles and a hot digest can be split.
    copies = materialise(digests.where("n > 1").drop("n"), "warc-copies")
    small = materialise(rows.select("page_id", "digest", "size"), "warc-digests")
    revisits = (
        small.where(F.col("size") >= min_bytes).join(copies, "digest").where("page_id > first or page_id is null")
        .select("page_id", "digest", "first").distinct()
    )
    marked = rows.join(revisits.withColumnsRenamed({"page_id": "_page", "digest": "_digest"}), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("first").isNotNull()
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    seconds = F.unix_timestamp(F.lit(start)) + F.coalesce(F.col("page_id"), F.lit(0))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), named(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), named(F.col("first")))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
    )
    record = F.concat(head, F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    marked.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 50_000).text(path)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive."""
    while line := stream.readline():
        if line.rstrip(b"\r\n") != b"WARC/1.1":
            raise ValueError(f"no record starts at {line[:40]!r}")
        head = {}
        while (line := stream.readline().decode()) != "\r\n":
            name, _, value = line.rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{head['WARC-Record-ID']} does not end after its block")
        yield head, block


def _id(name: str | None) -> int | None:
    number = (name or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if number == "none" else int(number)


def _order(row: tuple) -> tuple:
    """URL key, timestamp, id; UTF-8 order, nulls first."""
    return row[2].encode(), row[3], row[4] is not None, row[4] or 0


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1)):
            rows = []
            for head, block in records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(head["WARC-Payload-Length"])
                if head["WARC-Type"] == "response" and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
                    raise ValueError(f"{head['WARC-Record-ID']} does not match its digest")
                refers = _id(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                rows.append((name.as_py(), 0, url_key(head.get("WARC-Target-URI")), head["WARC-Date"], _id(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers))
            rows.sort(key=_order)
            for at in range(0, len(rows), 10_000):
                some = [(r[0], at + i, *r[2:]) for i, r in enumerate(rows[at : at + 10_000])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), RUN.types)], schema=RUN)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Locally sorted capture runs, one per archive, written to the shared folder."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return materialise(files.mapInArrow(_runs, DDL), "warc-runs")


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of a knockout, so a new head meets log2(k) of them."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.heads = [_order(r[0]) if r else None for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head goes first; an ended run loses, the earlier run wins a tie."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            held = self.tree[node]
            if held < 0:
                self.tree[node] = winner  # the other side has not played yet
                return
            if self._beats(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[first := self.tree[0]] is not None:
            run = self.runs[first]
            yield run[self.at[first]]
            self.at[first] += 1
            self.heads[first] = _order(run[self.at[first]]) if self.at[first] < len(run) else None
            self._play(first)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[0], []).append(row)
    out: list[tuple] = []
    for row in LoserTree(list(runs.values())):
        out.append(row)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), RUN.types)], schema=RUN)
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), RUN.types)], schema=RUN)


def merge(runs: DataFrame) -> DataFrame:
    """Captures in global order of URL key, timestamp and id; partitions follow one another.

    Ranges are cut over the whole key, so a URL with very many captures spreads over several; a range's rows
    come in run order, sorted and spilled by Spark, and only one range is in a task's memory.
    """
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(n, "url_key", "time", "page_id").sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(_merge, DDL)


def capture_histories(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write archives, read them back, and give the merged index a global position."""
    spark = pages.sparkSession
    small_batches(spark)
    path = new_path(spark, "warc")
    write(pages, path, min_bytes)
    return offsets_of(merge(read_index(spark, path)), "warc-merged", "history_pos")[0]
