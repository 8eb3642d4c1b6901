"""Sum-of-squares online packing of tokenised documents into fixed token windows.

Each scan partition packs its own documents in one streaming pass, so nothing is shuffled. A document's
tokens (its ids, then the end id) fill whole windows first; the remainder goes, online, to the fill level
whose choice makes the sum of squared counts of partially filled windows smallest. The counts are the
level array, one entry per fill level.

Defined results: null text is empty (one end id); repeated rows are packed once each; an empty table gives
no rows; a null doc_id is carried as null; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tiktoken_encoding

WINDOW = 2048
END_ID = 1
#: Windows that one task holds open; beyond it the open ones are topped up and closed. 8 kB each at most.
MAX_OPEN = 4096
#: Distinct text chunks of a generation whose ids a worker keeps; there are two.
CACHE = 150_000

#: A space that no word follows: white space of any kind, or the end.
_RUN = re.compile(r" (?:\s|\Z)")

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_tokenizers: dict[tuple, tuple] = {}


def _tokenizer(path: str, ranks: str, pattern: str):
    """The tokenizer, the same vocabulary as ranks for short chunks, and two generations of known chunks."""
    key = (path, ranks, pattern)
    if key not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[key] = (Tokenizer.from_file(path), tiktoken_encoding(ranks, pattern), {}, {})
    return _tokenizers[key]


def encode(texts: list[str], path: str, ranks: str, pattern: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    The byte-level vocabulary never merges across a space that a non-space follows, so a text is cut at each
    such space, and the ids of a chunk are worked out once while a worker knows it. The ids are those of the
    tokenizer file; the same vocabulary as tiktoken ranks gives them faster for short chunks. A text that could
    hold a special token's string goes to the tokenizer whole.
    """
    tokenizer, encoding, known, older = _tokenizer(path, ranks, pattern)
    ordinary = encoding.encode_ordinary
    if len(known) > CACHE:  # what was not met since the last time goes
        older.clear()
        older.update(known)
        known.clear()
    out = []
    for text in texts:
        if "<|" in text:
            out.append(np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            continue
        parts = text.split(" ")
        if _RUN.search(text):
            parts = _chunks(parts)
        else:
            parts[1:] = [" " + p for p in parts[1:]]
        for p in parts:
            if p not in known:
                known[p] = older.get(p) or array("I", ordinary(p)).tobytes()
        out.append(b"".join(map(known.__getitem__, parts)))
    return out


def _chunks(parts: list[str]) -> list[str]:
    """The pieces between single spaces, as chunks that start at a space which a non-space follows."""
    out, held = [], parts[0]
    for p in parts[1:]:
        if p == "" or p[0].isspace():
            held += " " + p
        else:
            if held:
                out.append(held)
            held = " " + p
    return out + [held] if held else out


class LevelArray:
    """Open windows by fill level; counts[h] windows are filled to h of ``window`` tokens."""

    def __init__(self, window: int):
        self.window, self.counts = window, np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def place(self, piece: tuple) -> list | None:
        """Put the piece (its length comes first) where the sum of squares grows least; the window if that filled it."""
        size, top = piece[0], self.window
        counts = self.counts
        least, level = 2 * int(counts[size]) + 1, 0  # a new window
        if self.n_open:
            here, there = counts[1 : top - size + 1], counts[1 + size : top + 1]
            grows = np.where(here > 0, 2 * (there - here) + 2, np.iinfo(np.int64).max)
            if len(grows):
                if here[-1] > 0:
                    grows[-1] = 1 - 2 * here[-1]  # full windows are no longer counted
                best = int(grows.argmin())
                if grows[best] <= least:
                    level = best + 1
        if level:
            pieces = self.open[level].pop()
            counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == top:
            return pieces
        self.open.setdefault(level + size, []).append(pieces)
        counts[level + size] += 1
        self.n_open += 1
        return None

    def close(self) -> Iterator[list]:
        """Close all open windows: the emptiest are cut to fill up the fullest, so one at most stays unfilled."""
        left = [p for level in sorted(self.open, reverse=True) for p in self.open[level]]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        lo, hi = 0, len(left) - 1
        while lo <= hi:
            pieces = left[lo]
            room = self.window - sum(p[0] for p in pieces)
            while room and hi > lo:
                source = left[hi]
                size, doc, start, ids, total = source.pop()
                if size > room:
                    source.append((size - room, doc, start, ids[: 4 * (size - room)], total))
                    start, ids, size = start + size - room, ids[4 * (size - room) :], room
                pieces.append((size, doc, start, ids, total))
                room -= size
                hi -= not source
            yield pieces
            lo += 1


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: tuple, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    sequence = TaskContext.get().partitionId() << 40
    levels, end = LevelArray(window), np.array([end_id], "<u4").tobytes()
    rows: list[tuple] = []

    def emit(pieces: list) -> None:
        nonlocal sequence
        offset = 0
        for size, doc, start, ids, total in pieces:
            rows.append((doc, start, size, zlib.crc32(ids), total, sequence, offset))
            offset += size
        sequence += 1

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=SCHEMA)
            rows.clear()

    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for doc, ids in zip(batch.column(0).to_pylist(), encode(texts, *vocabulary)):
            ids += end
            total = len(ids) // 4
            whole = total // window * window
            for start in range(0, whole, window):
                emit([(window, doc, start, ids[4 * start : 4 * (start + window)], total)])
            if whole < total:
                full = levels.place((total - whole, doc, whole, ids[4 * whole :], total))
                if full:
                    emit(full)
            if levels.n_open >= MAX_OPEN:
                for pieces in levels.close():
                    emit(pieces)
        yield from flush()
    for pieces in levels.close():
        emit(pieces)
    yield from flush()


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return chosen.mapInArrow(partial(_pack, vocabulary=(tokenizer_path, ranks_path, pattern), window=window, end_id=end_id), DDL)
