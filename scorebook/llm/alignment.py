"""Cross-tokenizer alignment: which tokens of two vocabularies end together, counted over all documents.

Each text is encoded by a byte-level vocabulary (A, with a space in front) and by a piece vocabulary (B, which adds
that space itself). Where tokens of both end at one byte, the pair is linked. A scan task sorts the records (pair,
document, times) of some documents side-major, by B's id and then A's, deals them to radixes of B's id, and writes
each radix as one compressed run to the shared folder. Runs of a radix are then merged through a heap, ``FAN`` at a
time in as many rounds as it takes; the merged run is in order of B's id, so each id's highest count falls out of the
same pass. Last, each task streams its own runs again and hands every document the counts of its pairs.

Only pairs and their counts are shuffled. Two tokens that end at one byte are suffix and whole, so the number of
pairs is bounded by the vocabularies (``possible_pairs``; some 10^5 for vocabularies of 50,000 and 32,000), however
many documents there are. That bound is why the merged counts may be broadcast.

Defined results: null, empty, or changed texts (the joined bytes of A's or B's tokens are not space and text) have no
tokens and zeros; repeated rows count and are returned once each; a null doc_id is carried as null; an empty table
gives no rows; strings of special tokens are plain text; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pack, small_batches, tiktoken_encoding, unpack

#: Links of the documents whose records are sorted together; a longer document is sorted alone.
CHUNK_LINKS = 1_000_000
RADIXES = 64
#: Runs that one merge reads.
FAN = 128
#: Distinct pieces of text of a generation whose tokens a worker keeps, and their longest; there are two generations.
CACHE, CACHED_CHARS = 150_000, 64

# A cut is a space with text on both sides: no token of either vocabulary runs over it.
_UNEVEN = re.compile(r" (?:\s|\Z)|\s ")

DOC = pa.struct([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])
BLOBS = ("keys", "totals", "documents", "places", "times")
CHUNK = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(DOC)), *((n, pa.list_(pa.binary())) for n in BLOBS)])
CHUNK_DDL = "chunk long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>, " + ", ".join(
    f"{n} array<binary>" for n in BLOBS
)
RUN = pa.schema([("radix", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("totals", pa.binary()), ("best", pa.binary())])
RUN_DDL = "radix int, chunk long, keys binary, totals binary, best binary"
OUT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligner:
    """Both vocabularies, the bytes of their tokens, and two generations of known pieces of text."""

    def __init__(self, a_path: str, a_ranks: str, pattern: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(a_path)
        self.whole.encode_special_tokens = True
        self.short = tiktoken_encoding(a_ranks, pattern)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = a_tokens(a_ranks), b_tokens(self.pieces)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _aligned(self, text: str) -> tuple | None:
        """(tokens of A, of B, groups, their ids as text, the links' keys) of text that starts with a space; None if bytes differ."""
        a = self.short.encode_ordinary(text) if len(text) < 256 else self.whole.encode(text, add_special_tokens=False).ids
        b = self.pieces.encode(text[1:])
        raw = text.encode()
        a_own, b_own = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_own) != raw or b"".join(b_own) != raw:
            return None
        groups, keys = [], []
        i = j = a_end = b_end = a_from = b_from = 0
        while i < len(a) or j < len(b):
            if a_end <= b_end:
                a_end += len(a_own[i])
                i += 1
            else:
                b_end += len(b_own[j])
                j += 1
            if a_end == b_end:
                groups.append(",".join(map(str, a[a_from:i])) + "|" + ",".join(map(str, b[b_from:j])))
                keys.append(b[j - 1] << 16 | a[i - 1])
                a_from, b_from = i, j
        return len(a), len(b), len(groups), ";".join(groups), np.array(keys, np.uint32).tobytes()

    def align(self, text: str) -> tuple | None:
        """As for a piece, of a whole text; it is cut where no token runs over and the pieces are looked up."""
        if not text:
            return None
        parts = _pieces(text)
        known, older = self.known, self.older
        found = []
        for p in parts:
            one = known.get(p, 0)
            if one == 0:
                one = older.get(p, 0)
                if one == 0:
                    one = self._aligned(p)
                if len(p) <= CACHED_CHARS:
                    known[p] = one
            if one is None:
                return None
            found.append(one)
        if len(known) > CACHE:  # what was not met since the last time goes
            self.older, self.known = known, {}
        n_a, n_b, n_groups, groups, keys = zip(*found)
        return sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(keys)


def _pieces(text: str) -> list[str]:
    """Space and text, cut before each space that has text on both sides."""
    parts = text.split(" ")
    if not _UNEVEN.search(" " + text):
        return [" " + p for p in parts]
    out, held = [], " " + parts[0]
    for p in parts[1:]:
        if p and not p[0].isspace() and not held[-1].isspace():
            out.append(held)
            held = " " + p
        else:
            held += " " + p
    return [*out, held]


def a_tokens(ranks: str) -> dict[int, bytes]:
    """Bytes of each entry of the byte-level vocabulary."""
    with open(ranks, "rb") as lines:
        return {int(i): base64.b64decode(t) for t, i in map(bytes.split, lines)}


def b_tokens(pieces) -> list[bytes]:
    """Bytes of each piece: the mark is a space, byte pieces are their byte."""
    texts = (pieces.id_to_piece(i) for i in range(pieces.get_piece_size()))
    return [bytes([int(t[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", t) else t.replace("▁", " ").encode() for t in texts]


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs can ever be linked: one token's bytes end the other's."""
    a_all, b_all = set(a), set(b)
    return sum(t[k:] in b_all for t in a_all for k in range(len(t))) + sum(t[k:] in a_all for t in b_all for k in range(1, len(t)))


_aligners: dict[tuple, Aligner] = {}


def _aligner(vocabularies: tuple) -> Aligner:
    if vocabularies not in _aligners:
        _aligners[vocabularies] = Aligner(*vocabularies)
    return _aligners[vocabularies]


def _chunk(number: int, docs: list[dict], links: list[bytes]) -> pa.RecordBatch:
    """One row: the documents, and their records as a run for each radix, in order of pair and document."""
    sizes = [len(x) // 4 for x in links]
    keys = np.frombuffer(b"".join(links), np.uint32).astype(np.uint64)
    records, times = np.unique(keys << np.uint64(32) | np.repeat(np.arange(len(docs), dtype=np.uint64), sizes), return_counts=True)
    pair, place = records >> np.uint64(32), (records & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    radix = (pair >> np.uint64(16)) % np.uint64(RADIXES)
    blobs: dict[str, list[bytes]] = {n: [] for n in BLOBS}
    for r in range(RADIXES):
        own = np.flatnonzero(radix == r)
        distinct, first = np.unique(pair[own], return_index=True)
        n = times[own]
        blobs["keys"].append(pack(distinct))
        blobs["totals"].append(pack(np.add.reduceat(n, first).astype(np.int64)) if len(own) else b"")
        blobs["documents"].append(pack(np.diff(first, append=len(own)).astype(np.uint32)) if len(own) else b"")
        blobs["places"].append(pack(np.diff(place[own], prepend=np.uint32(0))) if len(own) else b"")
        blobs["times"].append(pack(n.astype(np.uint32)) if len(own) else b"")
    columns = [pa.array([number], pa.int64()), pa.array([docs], CHUNK.field("docs").type), *(pa.array([blobs[n]], pa.list_(pa.binary())) for n in BLOBS)]
    return pa.RecordBatch.from_arrays(columns, schema=CHUNK)


def _scan(batches: Iterator[pa.RecordBatch], vocabularies: tuple, chunk_links: int) -> Iterator[pa.RecordBatch]:
    aligner, number = _aligner(vocabularies), TaskContext.get().partitionId() << 32
    docs: list[dict] = []
    links: list[bytes] = []
    held = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n_a, n_b, n_groups, groups, keys = aligner.align(text or "") or (0, 0, 0, "", b"")
            digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
            docs.append({"doc_id": doc, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_groups, "groups_sha256": digest})
            links.append(keys)
            held += n_groups
            if held >= chunk_links or len(docs) >= chunk_links:
                yield _chunk(number, docs, links)
                number, docs, links, held = number + 1, [], [], 0
    if docs:
        yield _chunk(number, docs, links)


def _merge(runs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one radix and group become one, through a heap of their heads; the highest count of each B id falls out of its order."""
    heads, radix, chunk = [], None, None
    for batch in runs:
        for row in batch.to_pylist():
            radix, chunk = row["radix"], row["chunk"]
            heads.append(zip(unpack(row["keys"], np.uint64).tolist(), unpack(row["totals"], np.int64).tolist()))
    keys, totals = [], []
    for key, same in groupby(heapq.merge(*heads), itemgetter(0)):
        keys.append(key)
        totals.append(sum(n for _, n in same))
    count = np.array(totals, np.int64)
    side = np.array(keys, np.uint64) >> np.uint64(16)
    starts = np.flatnonzero(np.diff(side, prepend=np.uint64(1 << 40)))
    highest = np.repeat(np.maximum.reduceat(count, starts), np.diff(starts, append=len(side)))
    row = {"radix": radix, "chunk": chunk, "keys": pack(np.array(keys, np.uint64)), "totals": pack(count), "best": pack((count == highest).astype(np.uint8))}
    yield pa.RecordBatch.from_pylist([row], schema=RUN)


def merged(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """One run per radix: its pairs, their counts, and whether a count is its B id's highest."""
    groups = chunks.count()
    runs = chunks.select("chunk", F.posexplode(F.arrays_zip("keys", "totals")).alias("radix", "r")).select("radix", "chunk", "r.keys", "r.totals", F.lit(None).cast("binary").alias("best"))
    runs = runs.where(F.octet_length("totals") > 0)
    while True:
        groups = max(1, -(-groups // fan))
        dealt = runs.withColumn("chunk", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
        runs = dealt.groupBy("radix", "chunk").applyInArrow(_merge_group, RUN_DDL)
        if groups == 1:
            return materialise(runs, "alignment-counts")
        runs = materialise(runs, "alignment-runs")


def _merge_group(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(_merge(iter(table.to_batches()))), schema=RUN)


def _contribute(batches: Iterator[pa.RecordBatch], counts) -> Iterator[pa.RecordBatch]:
    """Each document's sums over its links, from the runs of its chunk and the merged counts."""
    keys, totals, best = counts.value
    for batch in batches:
        for row in batch.to_pylist():
            docs = row["docs"]
            count_sum, n_best = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            for r in range(RADIXES):
                if not row["times"][r]:
                    continue
                at = np.repeat(np.searchsorted(keys, unpack(row["keys"][r], np.uint64)), unpack(row["documents"][r], np.uint32))
                place, times = np.cumsum(unpack(row["places"][r], np.uint32), dtype=np.uint32), unpack(row["times"][r], np.uint32).astype(np.int64)
                np.add.at(count_sum, place, totals[at] * times)
                np.add.at(n_best, place, best[at] * times)
            columns = {n: [d[n] for d in docs] for n in OUT.names if n not in ("n_best", "count_sum")} | {"n_best": n_best, "count_sum": count_sum}
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in zip(OUT.names, OUT.types)], schema=OUT)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            key, total, best = unpack(row["keys"], np.uint64).astype(np.int64), unpack(row["totals"], np.int64), unpack(row["best"], np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(key & 0xFFFF), pa.array(key >> 16), pa.array(total), pa.array(best > 0)], names=["a_id", "b_id", "links", "best"])


def pairs(docs: DataFrame, vocabularies: tuple, chunk_links: int = CHUNK_LINKS, fan: int = FAN) -> DataFrame:
    """a_id, b_id, links, best: every linked pair with its count, and whether that is its B id's highest."""
    return merged(_chunks(docs, vocabularies, chunk_links), fan).mapInArrow(_pair_rows, "a_id long, b_id long, links long, best boolean")


def _chunks(docs: DataFrame, vocabularies: tuple, chunk_links: int) -> DataFrame:
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return materialise(chosen.mapInArrow(partial(_scan, vocabularies=vocabularies, chunk_links=chunk_links), CHUNK_DDL), "alignment-chunks")


def align(docs: DataFrame, vocabularies: tuple, chunk_links: int = CHUNK_LINKS, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    vocabularies: A's tokenizer file, the same as ranks, the pattern that cuts a text before merging, B's model.
    """
    chunks = _chunks(docs, vocabularies, chunk_links)
    runs = merged(chunks, fan).select("keys", "totals", "best").collect()  # RADIXES rows; possible_pairs() bounds their length
    parts = [np.concatenate([unpack(r[n], kind) for r in runs]) if runs else np.zeros(0, kind) for n, kind in (("keys", np.uint64), ("totals", np.int64), ("best", np.uint8))]
    order = np.argsort(parts[0])
    counts = docs.sparkSession.sparkContext.broadcast(tuple(p[order].astype(kind) for p, kind in zip(parts, (np.uint64, np.int64, np.int64))))
    return chunks.mapInArrow(partial(_contribute, counts=counts), OUT_DDL)
