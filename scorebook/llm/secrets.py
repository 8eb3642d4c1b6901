"""Secret scan: fixed rules for keys and passwords, and a token-efficiency test for random strings.

A random string breaks into many short vocabulary pieces, so its characters-per-token ratio under a
public byte-level vocabulary is low. Candidates are long runs of letters, digits and +/_- with a letter; those
without a digit are held to a stricter ratio. Known digests (pure hex of a usual digest length), UUIDs, times
and numbers are excluded before the ratio is taken.

Defined results: null or empty text has no spans; repeated rows are scanned once each; an empty table gives
no rows; spans count code points, end exclusive; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tiktoken_encoding

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PURE_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
#: Characters per token at or under which a candidate counts as random.
MAX_RATIO = 2.0
#: The same for candidates without a digit, so that ordinary words stay out.
LETTERS_RATIO = 1.5

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64()),
])
DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"

def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed rules, leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """Spans that the token-efficiency test finds."""
    found = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not any(c.isalpha() for c in s):
            continue
        if UUID.fullmatch(s) or (len(s) in DIGEST_LENGTHS and PURE_HEX.fullmatch(s)):
            continue
        ratio = max_ratio if any(c.isdigit() for c in s) else min(max_ratio, LETTERS_RATIO)
        if len(s) <= ratio * len(encoding.encode_ordinary(s)):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scan(batches: Iterator[pa.RecordBatch], path: str, pattern: str, max_ratio: float) -> Iterator[pa.RecordBatch]:
    encoding = tiktoken_encoding(path, pattern)
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            base = base_spans(text)
            more = random_spans(text, encoding, max_ratio)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)] if rows else [pa.array([], t) for t in SCHEMA.types], schema=SCHEMA)


def scan(docs: DataFrame, vocabulary_path: str, pattern: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per document with span counts, the digest of the fixed rules' spans, and all spans."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return chosen.mapInArrow(partial(_scan, path=vocabulary_path, pattern=pattern, max_ratio=max_ratio), DDL)


def _redact(batches: Iterator[pa.RecordBatch], path: str, pattern: str, max_ratio: float, mark: str) -> Iterator[pa.RecordBatch]:
    encoding = tiktoken_encoding(path, pattern)
    for batch in batches:
        out = []
        for text in batch.column("text"):
            text = text.as_py()
            spans = sorted((a, b) for a, _, b in base_spans(text) + random_spans(text, encoding, max_ratio)) if text else []
            if spans:
                kept, at = [], 0
                for a, b in spans:
                    if a >= at:
                        kept += [text[at:a], mark]
                    at = max(at, b)
                text = "".join(kept) + text[at:]
            out.append(text)
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))


def redact(docs: DataFrame, vocabulary_path: str, pattern: str, max_ratio: float = MAX_RATIO, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each found span, overlapping ones merged, replaced by ``mark``; other columns as they were."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_redact, path=vocabulary_path, pattern=pattern, max_ratio=max_ratio, mark=mark), docs.schema)
