"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

One pass over the texts turns each distinct set of shingles of a scan task into a node and deals its incidence
entries, sorted and delta-coded, into blocks by shingle. A block's task keeps the columns that two nodes hold; a
column that many sets of a chunk hold is dealt to several tasks, as parts of one list.

Linked sets share at least 75 % of either. So a node with fewer shingles in common with others links with
none, which leaves out nearly all texts before any pair is formed. Of the rest, columns with equal nodes are one list
with a multiplicity, so overlaps are sums over lists. Links are found in two steps, both on exact overlap counts:

* Each list names the node whose shingles are the most common ones, such as the text that others were copied from.
  Each node is held against the one it meets most often, a number of pairs linear in the nodes. Links join into
  components, so that large groups of copies never become all their pairs.
* Only lists that nodes of different components hold still matter. Of two components, the nodes of the smaller one
  are looked up in the larger one: they are dealt into slices, and a slice's task multiplies its nodes' incidence
  with that of all nodes in their lists, block by block, and discards the pairs under the size-derived bound.

Nodes are named by place, so ``docs`` must give its rows in the same order when a task is repeated, as scans of
files do. Equal sets of different tasks are found by a digest of the whole set; of each group one node stays in the
lists and the others are linked to it, so copies over many tasks never meet each other in a list.

Defined results: null or empty text and text without words has 0 shingles and its own component; repeated
rows (same id) give a row each; null ids are kept and name no component, so one without other ids has none; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches as as_batches
from .common import discard, free_name, materialise, pack, small_batches, text_bytes, unpack
from .components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
class Bounds(NamedTuple):
    """Sizes of the work in one task; no result depends on them."""

    #: Incidence entries and sets that a task holds before it deals them out; sets are numbered in 16 bits.
    chunk_entries: int = 600_000
    chunk_sets: int = 60_000
    #: Bytes of text per block of columns.
    block_bytes: int = 4_000_000
    #: Sets of a chunk in a column from which on it is dealt to several tasks, and to how many.
    hot: int = 64
    parts: int = 16
    #: Nodes of a part of a list.
    segment: int = 1 << 16
    #: Bytes of text from which on chunks, blocks and ``hot`` grow with the root of the input, and by how much at most:
    #: until then chunks times blocks, the number of messages, is in proportion to the input.
    grow_bytes: int = 1 << 30
    grow_most: int = 4
    #: Incidence entries of a slice, pairs that its task counts at once, and lists that it multiplies at once.
    slice_entries: int = 200_000
    tile: int = 8_000_000
    lists: int = 256


def _grown(bounds: Bounds, size: int) -> Bounds:
    """The bounds for texts of so many bytes."""
    by = min(bounds.grow_most, max(1, (size / bounds.grow_bytes) ** 0.5))
    return bounds._replace(chunk_entries=int(bounds.chunk_entries * by), block_bytes=int(bounds.block_bytes * by), hot=int(bounds.hot * by))


#: Sets of a task that are known again; then they start anew.
KNOWN_SETS = 1_000_000
#: Bytes of a word that are hashed by table (longer words by digest), and of texts that are hashed at once.
LONG, PIECE = 64, 1 << 18
#: A random number for each byte at each place of a word; fixed, so that all tasks name a word alike.
_TABLE = np.frombuffer(hashlib.shake_256(b"words").digest(LONG * 256 * 8), "<u8")
_INSIDE = np.ones(256, np.int8)
_INSIDE[list(b" \t\n\v\f\r")] = 0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the text start, A-Z lower-cased, and their hashes: sums of the table's numbers."""
    raw = np.frombuffer(text.lower(), np.uint8)
    edges = np.flatnonzero(np.diff(_INSIDE[raw], prepend=0, append=0))
    starts, long = edges[::2], edges[1::2] - edges[::2]
    n = np.minimum(long, LONG)
    out = np.empty(len(starts), np.uint64)
    ends = np.cumsum(n)
    for lo, hi in zip(cuts := np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + 1 if len(ends) else 0, PIECE))), [*cuts[1:], len(starts)]):
        place = _ranges(np.zeros(hi - lo, np.int64), n[lo:hi])
        byte = raw[_ranges(starts[lo:hi], n[lo:hi])]
        out[lo:hi] = np.add.reduceat(_TABLE[place * 256 + byte], ends[lo:hi] - n[lo:hi] - (ends[lo] - n[lo]))
    for i in np.flatnonzero(long > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : starts[i] + long[i]].tobytes(), digest_size=8).digest(), "little")
    return starts, out


def _named(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words."""
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ words[i : n + i]) * _ODD
        h ^= h >> np.uint64(29)
    return _mixed(h)


def _sets(texts: Iterator[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its word n-grams; the whole sequence if it has fewer words."""
    held: list[bytes] = []

    def flush() -> Iterator[np.ndarray]:
        starts, w = _words(b"\n".join(held))
        at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in held)]))
        every = _named(w, words) if len(w) >= words else np.empty(0, np.uint64)
        for lo, hi in zip(at[:-1], at[1:]):
            h = np.sort(every[lo : hi - words + 1] if hi - lo >= words else _named(w[lo:hi], hi - lo) if hi > lo else every[:0])
            yield h[np.r_[True, h[1:] != h[:-1]][: len(h)]]

    n_held = 0
    for text in texts:
        held.append(text)
        n_held += len(text) + 1
        if n_held >= PIECE:
            yield from flush()
            held.clear()
            n_held = 0
    if held:
        yield from flush()


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; the whole sequence if it has fewer words."""
    return next(_sets(iter([text]), words))


MESSAGE = pa.schema([
    ("block", pa.int64()), ("part", pa.int32()), ("base", pa.int64()), ("h", pa.binary()), ("places", pa.binary()), ("hot", pa.binary()),
    ("own", pa.binary()), ("keys", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
])
MESSAGE_DDL = "block long, part int, base long, h binary, places binary, hot binary, own binary, keys array<binary>, ids array<long>, docs array<long>, sizes array<long>"
#: ``columns`` are numbers within the block, or shingles (dealt) if the column is in several tasks.
ENTRIES = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("base", pa.int64()), ("dealt", pa.bool_()), ("columns", pa.binary()), ("places", pa.binary()), *list(MESSAGE)[6:]])
ENTRIES_DDL = "block long, part int, base long, dealt boolean, columns binary, places binary, own binary, keys array<binary>, ids array<long>, docs array<long>, sizes array<long>"
ABLE_DDL = "block long, part int, dealt boolean, base long, columns binary, places binary, sizes binary"
PACKED_DDL = "bucket long, dealt boolean, names binary, times binary, widths binary, nodes binary, sizes binary"
LISTS_DDL = "list long, times long, nodes array<long>, sizes array<int>"
#: Lists of a slice: places of the slice's own nodes ``xn`` and of all nodes ``yn``, as row times their number plus place.
SLICES = pa.schema([("slice", pa.int64()), *((c, pa.binary()) for c in ("times", "xn", "xs", "yn", "ys", "sizes", "components"))])
SLICES_DDL = "slice long, times binary, xn binary, xs binary, yn binary, ys binary, sizes binary, components binary"


def _deal(batches: Iterator[pa.RecordBatch], blocks: int, words: int, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """Messages to the blocks: entries (shingle, place of the set after ``base``), columns dealt to parts, and rows (id, node, size)."""
    task = TaskContext.get().partitionId()
    known: dict[bytes, int] = {}
    held: list[np.ndarray] = []
    keys: list[bytes] = []
    rows: list[tuple] = []
    made = n_held = chunk = 0

    def flush() -> Iterator[pa.RecordBatch]:
        out, none = [], (None,) * 5
        base = (task << 40) + made - len(held)
        if held:
            h = np.concatenate(held)
            place = np.repeat(np.arange(len(held), dtype=np.uint16), list(map(len, held)))
            order = np.argsort(h, kind="stable")
            h, place = h[order], place[order]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            often = np.diff(np.r_[starts, len(h)])
            hot_h = h[starts[often >= bounds.hot]]
            for part, own in ((0, np.repeat(often < bounds.hot, often)), (1 + chunk % bounds.parts, np.repeat(often >= bounds.hot, often))):
                x, p = h[own], place[own]
                edges = (np.arange(blocks + 1, dtype=object) * (1 << 64) // blocks).tolist()
                at = np.r_[0, np.searchsorted(x, np.array(edges[1:-1], np.uint64)), len(x)] if blocks > 1 else np.array([0, len(x)])
                mark = np.r_[0, np.searchsorted(hot_h, np.array(edges[1:-1], np.uint64)), len(hot_h)] if blocks > 1 else np.array([0, len(hot_h)])
                for b in np.flatnonzero((at[1:] > at[:-1]) | ((mark[1:] > mark[:-1]) & (part == 0))):
                    hot = pack(hot_h[mark[b] : mark[b + 1]]) if part == 0 and mark[b + 1] > mark[b] else None
                    out.append((int(b), part, base, pack(x[at[b] : at[b + 1]]), pack(p[at[b] : at[b + 1]]), hot, *none))
        if rows:
            own = pack(np.array(list(map(len, held)), np.uint32))
            out.append(((task * 7919 + chunk) % blocks, 0, base, None, None, None, own, list(keys), *map(list, zip(*rows))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), MESSAGE.types)], schema=MESSAGE)
        held.clear()
        keys.clear()
        rows.clear()

    for batch in batches:
        for doc, s in zip(batch.column(0).to_pylist(), _sets((t.as_py() for t in batch.column(1)), words)):
            node = None
            if len(s):
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                node = known.get(key)
                if node is None:
                    if len(known) >= KNOWN_SETS:
                        known.clear()
                    node = known[key] = (task << 40) + made
                    made += 1
                    held.append(s)
                    keys.append(key)
                    n_held += len(s)
            rows.append((doc, node, len(s)))
            if n_held > bounds.chunk_entries or len(rows) >= bounds.chunk_sets:
                yield from flush()
                n_held, chunk = 0, chunk + 1
    yield from flush()


def _rows(rows: list[tuple], types: list, names: list[str]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start ... start + length - 1 of each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _repeated(key: tuple, table: pa.Table) -> pa.Table:
    """Of each chunk, the entries in columns of the block that at least two nodes hold; parts of dealt ones; the rows as they came."""
    block, part = key[0].as_py(), key[1].as_py()
    hs, places, bases, hot = [], [], [], []
    rows = table.filter(pc.is_valid(table["ids"]))
    out = [pa.table([*(rows[c].combine_chunks() if c in rows.column_names else pa.nulls(len(rows), t) for c, t in zip(ENTRIES.names, ENTRIES.types))], schema=ENTRIES)]
    out[0] = out[0].set_column(5, "places", pa.nulls(len(rows), pa.binary()))
    for base, h, p, mark in zip(*(table.filter(pc.is_valid(table["h"]))[c].to_pylist() for c in ("base", "h", "places", "hot"))):
        hs.append(unpack(h, np.uint64))
        places.append(unpack(p, np.uint16))
        bases.append(base)
        if mark is not None:
            hot.append(unpack(mark, np.uint64))
    if not hs:
        return out[0]
    h, place = np.concatenate(hs), np.concatenate(places)
    source = np.repeat(np.arange(len(hs)), list(map(len, hs)))
    order = np.argsort(h, kind="stable")
    h, place, source = h[order], place[order], source[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    often = np.diff(np.r_[starts, len(h)])
    dealt = np.ones(len(starts), bool) if part else np.isin(h[starts], np.concatenate(hot) if hot else np.empty(0, np.uint64))
    number = np.repeat(np.cumsum(~dealt & (often > 1)).astype(np.uint64), often)
    found = []
    for named, use, name in ((False, ~dealt & (often > 1), number), (True, dealt, h)):
        own = np.flatnonzero(np.repeat(use, often))
        own = own[np.argsort(source[own], kind="stable")]  # in a chunk still by column
        at = np.searchsorted(source[own], np.arange(len(bases) + 1))
        for i in np.flatnonzero(at[1:] > at[:-1]):
            mine = own[at[i] : at[i + 1]]
            found.append((block, part, bases[i], named, pack(name[mine]), pack(place[mine]), *(None,) * 5))
    if found:
        out.append(pa.table([pa.array(c, t) for c, t in zip(zip(*found), ENTRIES.types)], schema=ENTRIES))
    return pa.concat_tables(out)


def _able(table: pa.Table, num: int, den: int) -> pa.Table:
    """A chunk's entries of nodes with enough of their shingles in common with others; of equal sets one node's only."""
    size = [unpack(x, np.uint32).astype(np.int64) for x in table["own"].to_pylist() if x is not None]
    size = np.concatenate([*size, np.empty(0, np.int64)])
    some = table.filter(pc.is_valid(table["places"]))
    places = [unpack(x, np.uint16) for x in some["places"].to_pylist()]
    able = np.bincount(np.concatenate([*places, np.empty(0, np.uint16)]).astype(np.int64), minlength=len(size)) * den >= num * size
    able[[p for gone in table["twins"].to_pylist() for p in gone or ()]] = False
    out = []
    for block, part, base, dealt, columns, p in zip(*(some[c].to_pylist() for c in ("block", "part", "base", "dealt", "columns")), places):
        ok = able[p]
        if ok.any():
            out.append((block, part, dealt, base, pack(unpack(columns, np.uint64)[ok]), pack(p[ok]), pack(size[p[ok]].astype(np.uint32))))
    return _rows(out, [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), *[pa.binary()] * 3], ["block", "part", "dealt", "base", "columns", "places", "sizes"])


def _listed(key: tuple, table: pa.Table, segment: int, buckets: int) -> pa.Table:
    """The block's lists of nodes, equal columns once with their number, dealt to buckets by what they hold.

    Columns in several tasks come in segments, named by shingle, and are not compared.
    """
    out = []
    for dealt in (False, True):
        own = table.filter(pc.equal(table["dealt"], dealt))
        if not len(own):
            continue
        column = np.concatenate([unpack(x, np.uint64) for x in own["columns"].to_pylist()])
        node = np.concatenate([b + unpack(x, np.uint16).astype(np.int64) for b, x in zip(own["base"].to_pylist(), own["places"].to_pylist())])
        size = np.concatenate([unpack(x, np.uint32) for x in own["sizes"].to_pylist()])
        order = np.lexsort((node, column))
        column, node, size = column[order], node[order], size[order]
        starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        n = np.diff(np.r_[starts, len(column)])
        if dealt:
            cuts = -(-n // segment)
            at = _ranges(np.zeros(len(n), np.int64), cuts) * segment
            starts, n = np.repeat(starts, cuts) + at, np.minimum(segment, np.repeat(n, cuts) - at)
            name, times = column[starts], np.ones(len(starts), np.uint32)
        else:
            mix = (node.view(np.uint64) + np.uint64(1)) * _ODD
            sums = np.add.reduceat(_mixed(mix ^ mix >> np.uint64(29)), starts)
            starts, sums, n = starts[n > 1], sums[n > 1], n[n > 1]
            name, first, times = np.unique(_mixed(sums + n.astype(np.uint64)), return_index=True, return_counts=True)
            starts, n = starts[first], n[first]
        bucket = (name % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(bucket):
            mine = np.flatnonzero(bucket == b)
            at = _ranges(starts[mine], n[mine])
            packed = (name[mine].view(np.int64), times[mine].astype(np.uint32), n[mine].astype(np.uint32), node[at], size[at])
            out.append((int(b), dealt, *map(pack, packed)))
    return _rows(out, [pa.int64(), pa.bool_(), *[pa.binary()] * 5], ["bucket", "dealt", "names", "times", "widths", "nodes", "sizes"])


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """The bucket's lists, equal ones of all blocks once with their number."""
    out = []
    for dealt in (False, True):
        own = table.filter(pc.equal(table["dealt"], dealt))
        if not len(own):
            continue
        kinds = {"names": np.int64, "times": np.uint32, "widths": np.uint32, "nodes": np.int64, "sizes": np.uint32}
        name, times, n, node, size = (np.concatenate([unpack(x, k) for x in own[c].to_pylist()]) for c, k in kinds.items())
        times, n = times.astype(np.int64), n.astype(np.int64)
        starts = np.cumsum(n) - n
        if dealt:
            name = ~(name.view(np.uint64) >> np.uint64(1)).view(np.int64)
        else:
            ids = [name, n, node[starts], node[starts + n - 1]]  # a digest of the nodes, their number, the first and the last
            order = np.lexsort(ids)
            new = np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in ids], axis=0)]
            times = np.add.reduceat(times[order], np.flatnonzero(new))
            starts, n = starts[order][new], n[order][new]
            name = (key[0].as_py() << 32) + np.arange(len(n))
        offsets, at = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), _ranges(starts, n)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (node[at], size[at].astype(np.int32))]
        out.append(pa.table([pa.array(name), pa.array(times), *lists], names=["list", "times", "nodes", "sizes"]))
    return pa.concat_tables(out)


def _sliced(batches: Iterator[pa.RecordBatch], bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """A task's rows (slice, times, xs, ys, sizes, components) by slice: each node once, lists as ascending places among them."""
    held: list[pa.RecordBatch] = []

    def flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
        """The lists' values and the numbers of their rows."""
        lists = table[column].combine_chunks()
        return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))

    def placed(values: np.ndarray, row: np.ndarray, among: np.ndarray) -> bytes:
        return pack(np.sort((row * len(among) + np.searchsorted(among, values)).astype(np.uint64)))

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        held.clear()
        name = table["slice"].to_numpy()
        order = np.argsort(name, kind="stable")
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(name[order])) + 1):
            own = table.take(pa.array(rows))
            (x, xrow), (y, yrow) = flat(own, "xs"), flat(own, "ys")
            ux, (uy, first) = np.unique(x), np.unique(y, return_index=True)
            of = pack(flat(own, "sizes")[0][first].astype(np.uint32)), pack(flat(own, "components")[0][first])
            times = pack(own["times"].to_numpy().astype(np.uint32))
            out.append((int(name[rows[0]]), times, pack(ux.view(np.uint64)), placed(x, xrow, ux), pack(uy.view(np.uint64)), placed(y, yrow, uy), *of))
        yield from as_batches(SLICES, out)

    n = 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch.column(3).flatten())
        if n > bounds.tile // 4:
            yield from flush()
            n = 0
    if held:
        yield from flush()


def _cross(table: pa.Table, num: int, den: int, bounds: Bounds) -> pa.Table:
    """Links (a, b) between a slice's nodes and those of other components; of those that join the same components one."""
    parts: list[list[np.ndarray]] = []
    n = 0
    for times, xn, xs, yn, ys, sizes, comps in zip(*(table[c].to_pylist() for c in SLICES.names[1:])):
        t, xn, yn, xs, ys = unpack(times, np.uint32), *(unpack(v, np.uint64).view(np.int64) for v in (xn, yn, xs, ys))
        parts.append([t, xn[xs % len(xn)], n + xs // len(xn), yn[ys % len(yn)], n + ys // len(yn), yn, unpack(sizes, np.uint32), unpack(comps, np.int64)])
        n += len(t)
    times, x, xrow, y, yrow, nodes, size, comp = map(np.concatenate, zip(*parts))
    parts.clear()
    times = times.astype(np.float32)
    uy, first = np.unique(nodes, return_index=True)
    comp, size, yi = comp[first], size[first].astype(np.int64), np.searchsorted(uy, y)
    ux, xi = np.unique(x, return_inverse=True)
    at = np.searchsorted(uy, ux)  # a node is in its own lists
    ny = np.bincount(yrow, minlength=n)
    order = np.argsort(ny, kind="stable")  # lists of like length share more of their nodes
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    xb, yb = place[xrow], place[yrow]
    by_x, by_y = np.argsort(xb, kind="stable"), np.argsort(yb, kind="stable")
    xi, xb, yi, yb = xi[by_x], xb[by_x], yi[by_y], yb[by_y]
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    a, b = [], []
    step = max(1, bounds.tile // max(1, len(uy)))
    for lo in range(0, len(ux), step):
        own = slice(lo, min(len(ux), lo + step))
        count = np.zeros((own.stop - lo, len(uy)), np.float32)
        for block in range(0, len(order), bounds.lists):
            xs = slice(*np.searchsorted(xb, [block, block + bounds.lists]))
            ys = slice(*np.searchsorted(yb, [block, block + bounds.lists]))
            use = (xi[xs] >= lo) & (xi[xs] < own.stop)
            rx, px = np.unique(xi[xs][use], return_inverse=True)
            if not len(rx):
                continue
            ry, py = np.unique(yi[ys], return_inverse=True)
            left, right = np.zeros((len(rx), bounds.lists), np.float32), np.zeros((len(ry), bounds.lists), np.float32)
            cx = xb[xs][use] - block
            left[px, cx] = times[order[cx + block]]
            right[py, yb[ys] - block] = 1
            count[np.ix_(rx - lo, ry)] += left @ right.T
        i, j = np.nonzero(count * den >= num * size[at[own]][:, None])
        shared, sx, sy = count[i, j].astype(np.int64), size[at[own]][i], size[j]
        ok = (shared * den >= num * (sx + sy - shared)) & (comp[at[own]][i] != comp[j])
        for p, q in zip(at[own][i[ok]].tolist(), j[ok].tolist()):
            u, v = root(int(comp[p])), root(int(comp[q]))
            if u != v:
                parent[u] = v
                a.append(int(uy[p]))
                b.append(int(uy[q]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _twins(found: DataFrame) -> DataFrame:
    """base, place, node and least of the nodes whose set an earlier node, the least one, has too."""
    sets = found.where("keys is not null").select("base", F.posexplode("keys").alias("place", "key")).withColumn("node", F.col("base") + F.col("place"))
    least = sets.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("many")).where("many > 1")
    return materialise(sets.join(least, "key").where("node > least").select("base", "place", "node", "least"), "join-twins")


def _incidence(lists: DataFrame, num: int, den: int) -> DataFrame:
    """list, segment, times and members (how common its shingles are, node, n): the nodes with enough of their shingles in lists."""
    rows = lists.select("list", "times", F.element_at("nodes", 1).alias("segment"), F.size("nodes").alias("width"), F.explode(F.arrays_zip("nodes", "sizes")).alias("e"))
    rows = rows.select("list", "segment", "times", "width", F.col("e.nodes").alias("node"), F.col("e.sizes").cast("long").alias("n"))
    common = F.sum(F.col("times") * F.log("width")) / F.max("n")
    able = rows.groupBy("node").agg(common.alias("common"), F.sum("times").alias("g"), F.max("n").alias("n")).where(f"{den}L * g >= {num}L * n")
    rows = rows.join(able.select("node", "common"), "node")
    cells = rows.groupBy("list", "segment").agg(F.max("times").alias("times"), F.collect_list(F.struct("common", "node", "n")).alias("members"))
    return materialise(cells, "join-incidence")


def _hub_links(cells: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of nodes with the most common node of their lists."""
    hubs = cells.withColumn("h", F.array_max("members")).select("times", "h", F.explode("members").alias("x"))
    met = hubs.select("times", F.col("x.node").alias("node"), F.col("x.n").alias("n"), F.col("h.node").alias("hub"), F.col("h.n").alias("m"))
    met = met.where(f"node <> hub and {den}L * least(n, m) >= {num}L * greatest(n, m)").groupBy("node", "hub", "n", "m").agg(F.sum("times").alias("shared"))
    # Lists where a node more common than the hub stands count for another pair, so this is the least that they share.
    return materialise(met.where(f"{den}L * shared >= {num}L * (n + m - shared)").select(F.col("hub").alias("a"), F.col("node").alias("b")), "join-links")


def _cross_links(cells: DataFrame, links: DataFrame, num: int, den: int, bounds: Bounds) -> DataFrame:
    """Links (a, b) between components of ``links``; all of them but those that others make needless."""
    label = materialise(components(links), "join-label")
    sizes = label.groupBy("component").agg(F.count("*").alias("many"))
    sized = materialise(label.join(sizes, "component"), "join-named")
    rows = cells.select("list", "segment", "times", F.explode("members").alias("x")).select("list", "segment", "times", F.col("x.node").alias("node"), F.col("x.n").alias("n"))
    rank = F.struct(F.coalesce("many", F.lit(1)).alias("many"), F.coalesce("component", "node").alias("component")).alias("rank")
    member = F.struct(rank, "node", "n")
    ranked = rows.join(sized, "node", "left").groupBy("list", "segment").agg(F.max("times").alias("times"), F.collect_list(member).alias("members"))
    ranked = materialise(ranked, "join-ranked")
    ends = ranked.select("list", F.array_min("members")["rank"].alias("lo"), F.array_max("members")["rank"].alias("hi"), F.size("members").alias("width"))
    mixed = ends.groupBy("list").agg(F.min("lo").alias("lo"), F.max("hi").alias("most"), F.sum("width").alias("width")).where("lo <> most")
    mixed = materialise(mixed.select("list", "most", "width"), "join-mixed")
    lists = ranked.join(mixed, "list")
    # Nodes of a smaller component that have enough shingles in common with larger ones.
    x = lists.select("list", "times", "width", F.col("most.component").alias("target"), F.explode(F.filter("members", lambda m: m["rank"] < F.col("most"))).alias("x"))
    x = x.select("list", "times", "width", "target", F.col("x.node").alias("node"), F.col("x.n").alias("n"))
    met = x.groupBy("node", "target").agg(F.sum("times").alias("g"), F.max("n").alias("n"), F.max("width").alias("width"))
    open_ = met.groupBy("node").agg(F.sum("g").alias("g"), F.max("n").alias("n"), F.max("width").alias("width"), F.max(F.struct("g", "target"))["target"].alias("target"))
    open_ = materialise(open_.where(f"{den}L * g >= {num}L * n"), "join-open")
    # Nodes that meet the same component share their lists, which go to each slice once. Slices hold many small
    # components, as a list that very many nodes hold goes to nearly every slice.
    parts = F.greatest(F.ceil(F.sum("n") / bounds.slice_entries), F.ceil(F.count("*") * F.max("width") / bounds.tile)).cast("long")
    many = 1 + (open_.agg(F.sum("n")).first()[0] or 0) // bounds.slice_entries
    named = F.when(F.col("parts") > 1, F.xxhash64("target", F.pmod(F.xxhash64("node"), "parts"))).otherwise(F.pmod(F.xxhash64("target"), F.lit(many)))
    slices = open_.join(open_.groupBy("target").agg(parts.alias("parts")), "target").select("node", named.alias("slice"))
    xs = x.select("list", "node").join(slices, "node").groupBy("slice", "list").agg(F.collect_list("node").alias("xs"))
    ys = lists.select("list", "times", F.col("members.node").alias("ys"), F.col("members.n").alias("sizes"), F.col("members.rank.component").alias("components"))
    rows = xs.join(ys, "list").select("slice", "times", "xs", "ys", "sizes", "components")
    rows = rows.mapInArrow(partial(_sliced, bounds=bounds), SLICES_DDL)
    out = materialise(rows.groupBy("slice").applyInArrow(_with(_cross, num=num, den=den, bounds=bounds), "a long, b long"), "join-links")
    discard(label, sized, ranked, mixed, open_)
    return out


def _with(function, **fixed):
    """The function of a group's key and table, or of its table alone, with the other arguments fixed."""
    if function is _cross or function is _able:
        return lambda table: function(table, **fixed)
    return lambda key, table: function(key, table, **fixed)


def join(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR, bounds: Bounds = Bounds()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; see the module."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bounds = _grown(bounds, size)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bounds.block_bytes))
    dealt = source.mapInArrow(partial(_deal, blocks=blocks, words=words, bounds=bounds), MESSAGE_DDL)
    found = materialise(dealt.groupBy("block", "part").applyInArrow(_with(_repeated), ENTRIES_DDL), "join-entries")
    row = F.explode(F.arrays_zip("ids", "docs", "sizes")).alias("r")
    rows = found.where("ids is not null").select(row).select(F.col("r.ids").alias("doc_id"), F.col("r.docs").alias("node"), F.col("r.sizes").alias("n"))
    twins = _twins(found)
    entries = found.drop("keys", "ids", "docs", "sizes").unionByName(twins.groupBy("base").agg(F.collect_list("place").alias("twins")), allowMissingColumns=True)
    able = entries.groupBy("base").applyInArrow(_with(_able, num=num, den=den), ABLE_DDL)
    listed = able.groupBy("block", "part").applyInArrow(_with(_listed, segment=bounds.segment, buckets=max(1, blocks // 8)), PACKED_DDL)
    lists = materialise(listed.groupBy("bucket").applyInArrow(_with(_merged), LISTS_DDL), "join-lists")
    cells = _incidence(lists, num, den)
    links = _hub_links(cells, num, den)
    more = _cross_links(cells, links, num, den, bounds)
    of = materialise(components(links.union(more).union(twins.select("least", "node"))), "join-label")
    ids = materialise(rows.join(of, "node", "left").withColumn("component", F.coalesce("component", "node")), "join-ids")
    smallest = materialise(ids.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least")), "join-least")
    named = ids.join(smallest, "component", "left")
    discard(found, twins, lists, cells, links, more, of)
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, the one with the smallest id, repeated rows once. Texts without words or id stay."""
    found = join(docs, **options).where("doc_id = component_id").select("doc_id")
    kept = docs.where("doc_id is not null").join(found, "doc_id", "left_semi")
    digest = free_name(docs, "digest")
    once = kept.withColumn(digest, F.md5(F.coalesce(F.col("text"), F.lit("")))).dropDuplicates(["doc_id", digest]).drop(digest)
    return once.unionByName(docs.where("doc_id is null"))
