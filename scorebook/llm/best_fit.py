"""Best-fit packing by minimum bin slack: whole documents into as few token windows as possible.

A window's content is decided on lengths alone: of the lengths that still have pieces, the longest is set and a
subset-sum search over bitsets finds what fills the rest best. That combination is then taken out as often as the
counts allow, which gives what taking it out once at a time would give. The counts of ``window`` lengths are all
that the search needs, whatever the number of documents, so it runs on the driver; pieces are numbered within
their length by one range shuffle of small rows and find their place in the plan by that number.

A document longer than a window is cut into whole windows, its first piece being what remains.

Defined results: null text is empty (one end id); repeated rows are packed once each; ties between equal lengths go
by doc_id, nulls first; an empty table gives no rows; a null doc_id is carried as null; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ranked, small_batches
from .packing import encode

WINDOW = 2048
END_ID = 0

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
DDL = PIECES_DDL + ", sequence_id long, offset long"


def _cut(batches: Iterator[pa.RecordBatch], vocabulary: tuple, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for doc, ids in zip(batch.column(0).to_pylist(), encode(texts, *vocabulary)):
            ids += end
            total = len(ids) // 4
            start, stop = 0, total % window or window
            for piece in range(-(-total // window)):
                rows.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                start, stop = stop, stop + window
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECES.types)], schema=PIECES)


def pieces(docs: DataFrame, vocabulary: tuple, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return chosen.mapInArrow(partial(_cut, vocabulary=vocabulary, window=window, end_id=end_id), PIECES_DDL)


class Slack:
    """Lengths that still have pieces, and for each the sums that it and the shorter ones can make, as bitsets."""

    def __init__(self, counts: dict[int, int], window: int):
        self.window, self.mask = window, (1 << (window + 1)) - 1
        self.counts = {n: c for n, c in counts.items() if c}
        self.lengths = sorted(self.counts)
        self.sums: list[int] = []
        self._sum(0)

    def _sum(self, at: int) -> None:
        """The bitsets of the lengths from place ``at`` on; bit s is set if sum s can be made."""
        del self.sums[at:]
        made = self.sums[-1] if self.sums else 1
        for n in self.lengths[at:]:
            left, step = min(self.counts[n], self.window // n), 1
            while left:  # copies in doubling bundles
                take = min(step, left)
                made |= (made << (take * n)) & self.mask
                left -= take
                step *= 2
            self.sums.append(made)

    def fullest(self) -> dict[int, int]:
        """The combination around the longest piece that leaves the least room; long pieces go before short ones."""
        top = len(self.lengths) - 1
        longest = self.lengths[top]
        use, room = {longest: 1}, self.window - longest
        self.counts[longest] -= 1
        if room >= longest:
            self._sum(top)  # without the piece that is set
        reach = self.sums[top] if room >= longest else self.sums[top - 1] if top else 1
        left = (reach & ((1 << (room + 1)) - 1)).bit_length() - 1
        for at in range(top, -1, -1):
            n, below = self.lengths[at], self.sums[at - 1] if at else 1
            most = min(self.counts[n], left // n)
            k = next((k for k in range(most, 0, -1) if below >> (left - k * n) & 1), 0)
            if k:
                use[n] = use.get(n, 0) + k
                left -= k * n
            if not left:
                break
        self.counts[longest] += 1
        return use

    def take(self, use: dict[int, int]) -> int:
        """Take the combination out as often as the counts allow; how often."""
        times = min(self.counts[n] // k for n, k in use.items())
        at = self.lengths.index(min(use))
        for n, k in use.items():
            self.counts[n] -= times * k
        if any(not self.counts[n] for n in use):
            self.lengths = [n for n in self.lengths if self.counts[n]]
        self._sum(at)
        return times


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(length, first, copies, sequence, offset): pieces number ``first`` and on of the length lie, ``copies`` to a
    sequence from ``offset`` on, in the sequences from ``sequence`` on. One entry per length and combination."""
    slack, out = Slack(counts, window), []
    used, sequence = dict.fromkeys(counts, 0), 0
    while slack.lengths:
        use = slack.fullest()
        times, offset = slack.take(use), 0
        for n, k in sorted(use.items(), reverse=True):
            out.append((n, used[n], k, sequence, offset))
            used[n] += times * k
            offset += n * k
        sequence += times
    return out


def _place(batches: Iterator[pa.RecordBatch], starts: np.ndarray, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each piece by its number over all lengths: the entry that it falls in, then its sequence and offset."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rank = batch.column("rank").to_numpy()
        at = np.searchsorted(starts, rank, side="right") - 1
        length, copies, sequence, offset = entries[at].T
        k = rank - starts[at]
        placed = [sequence + k // copies, offset + (k % copies) * length]
        columns = [batch.column(n) for n in PIECES.names] + [pa.array(x, pa.int64()) for x in placed]
        yield pa.RecordBatch.from_arrays(columns, names=[*PIECES.names, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialise(pieces(docs, (tokenizer_path, ranks_path, pattern), window, end_id), "best-fit-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    numbered, _ = ranked(cut, ["length", "doc_id", "piece"], "best-fit-ranked")
    before, below = {}, 0
    for n in sorted(counts):
        before[n], below = below, below + counts[n]
    entries = sorted((before[n] + first, n, copies, sequence, offset) for n, first, copies, sequence, offset in plan(counts, window))
    table = np.array(entries, np.int64).reshape(-1, 5)
    return numbered.mapInArrow(partial(_place, starts=table[:, 0].copy(), entries=table[:, 1:].copy()), DDL)
