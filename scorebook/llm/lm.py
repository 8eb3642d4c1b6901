"""N-gram language model as a weighted backoff automaton.

Words, pairs and triples of all training text are counted, named by 64-bit hashes, and stay distributed; only
pairs and triples that occur once are left out. A context's arcs are the n-grams that go on from it; its failure
arc leads to the next shorter context with the backoff weight.

Texts are written once in chunks. Each chunk asks for the counts of its distinct n-grams: their names go, sorted and
delta-coded, to blocks of the name space, and a block's task answers with the counts over all training text, one
answer per question. So most n-grams, which occur once, never become rows. With the counts at its places a chunk is
traversed left to right: at each place the longest arc is taken, which its counts give the weight of, and the failure
arcs that lead there are noted. One chunk of each n-gram, named by the block, hands its arc on to the sums that
give a context's failure weight. The weights of the most frequent contexts (the hot head, of bounded number) go to
every task; of the others each batch of rows asks blocks of the name space, once per block, which answer with sums by
row. The head's size changes no result.

Smoothing: the root is add-one over the training vocabulary, (c+1)/(N+V+1); higher contexts take an absolute
discount off each kept n-gram and give the freed mass to the failure arc, so each state's distribution sums to
one over the vocabulary and one unknown word.

A caller who gives a bound (``head``, ``bigram_words``, ``trigram_words``, ``max_grams``) gets a small model
instead, a whole automaton in every task over the most frequent words; no registered query does.

Defined results: null or empty text is the end token alone; repeated rows are scored once each and count once
each in training; with nothing to learn from every token has probability 1/(0+0+1); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_remainder, materialise, pack, settle, small_batches, text_bytes, unpack

#: Most frequent contexts whose failure weights each task holds; the others are asked for. Contexts of a block of those, about.
HOT, BLOCK_CONTEXTS = 1 << 20, 1 << 20
#: Tokens of a chunk, about; a longer text is a chunk of its own. Bytes of text per block of the name space.
CHUNK_TOKENS, BLOCK_BYTES = 500_000, 8_000_000
#: Bits of a name in questions beyond those that the bytes of all texts need: two n-grams share a name, and so their
#: counts, with a probability under 2^-22 each. Names have 64 bits at most.
SPARE_BITS = 22
#: Bounds of the small model, those not given: head words, words that n-grams may have (bigrams, trigrams), n-grams.
HEAD, BIGRAM_WORDS, TRIGRAM_WORDS, MAX_GRAMS = 1 << 18, 2048, 256, 200_000
DISCOUNT = 0.5
#: Distinct words, or n-grams of the small model, that a task counts before it hands them on.
FLUSH = 400_000
#: The end token's place among the words, which are never empty.
END = b""
_BITS, _TRI = 13, 1 << 40


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    names = ["word", "c"]

    def flush():
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=names)
            counts.clear()

    for batch in batches:
        for text in batch.column(0):
            counts.update(text.as_py().lower().split())
            counts[END] += 1
        if len(counts) > FLUSH:
            yield from flush()
    yield from flush()


def _at_most(counts: DataFrame, limit: int) -> int:
    """The smallest count such that at most ``limit`` rows have it or a larger one."""
    below = 0
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        below += r["n"]
        if below > limit:
            return r["c"] + 1
    return 1


class Head:
    """The most frequent words by rank, with counts; what a task needs to know of the vocabulary."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, distinct: int, texts: int):
        self.words, self.texts = words, texts
        self.counts, self.tokens, self.distinct = counts, tokens, distinct
        self.log10 = np.log10((counts + 1) / (tokens + distinct + 1))
        self.unseen = -math.log10(tokens + distinct + 1)

    def index(self, limit: int | None = None) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words[:limit])}


_indexes: dict[tuple, object] = {}


def _kept(key: tuple, make):
    """One worker keeps what the last query built."""
    if key not in _indexes:
        for k in [k for k in _indexes if k[0] == key[0]]:
            del _indexes[k]
        _indexes[key] = make()
    return _indexes[key]


def _count_grams(batches: Iterator[pa.RecordBatch], shared, key: str, bi: int, tri: int) -> Iterator[pa.RecordBatch]:
    """Counts of word pairs and triples within the gram vocabulary; ``bi`` itself stands for the beginning."""
    index = _kept(("grams", key), lambda: shared.value.index(bi))
    look, end = index.get, index.get(END, -1)
    held: list[np.ndarray] = []
    size = 0

    def merged():
        both = np.concatenate(held)
        return np.unique(both, return_counts=True)

    def flush():
        if held:
            k, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int64))], names=["gram", "c"])
            held.clear()

    for batch in batches:
        ids: list[int] = []
        for text in batch.column(0):
            ids.append(bi)
            ids += [look(w, -1) for w in text.as_py().lower().split()]
            ids.append(end)
            ids.append(-1)
        a = np.array(ids, np.int64)
        if not len(a):
            continue
        x, y = a[:-1], a[1:]
        both = (x >= 0) & (y >= 0) & (y < bi)
        held.append((x << _BITS | y)[both])
        few = (a >= 0) & ((a < tri) | (a == bi) | (a == end))
        x, y, z = a[:-2], a[1:-1], a[2:]
        three = few[:-2] & few[1:-1] & few[2:] & (z < bi) & (y < bi)
        held.append((_TRI | x << 2 * _BITS | y << _BITS | z)[three])
        size += len(held[-1]) + len(held[-2])
        if size > 10 * FLUSH:
            yield from flush()
            size = 0
    yield from flush()


class Automaton:
    """States are contexts with arcs; 0 is the root."""

    def __init__(self, head: Head, grams: np.ndarray, counts: np.ndarray, bi: int, discount: float = DISCOUNT):
        count = dict(zip(grams.tolist(), counts.tolist()))
        mask = (1 << _BITS) - 1
        follow: dict[tuple, list[tuple[int, int]]] = {}
        for g, c in count.items():
            context = (g >> 2 * _BITS & mask, g >> _BITS & mask) if g & _TRI else (g >> _BITS,)
            follow.setdefault(context, []).append((g & mask, c))
        follow = {k: v for k, v in follow.items() if len(k) == 1 or k[0] << _BITS | k[1] in count}
        state = {(): 0} | {k: i + 1 for i, k in enumerate(sorted(follow, key=lambda k: (len(k), k)))}
        self.arcs: dict[int, tuple[float, int]] = {}
        self.fail = [0] * len(state)
        self.back = [0.0] * len(state)
        uni = (head.counts + 1) / (head.tokens + head.distinct + 1)

        def longest(context: tuple) -> int:
            while context not in state:
                context = context[1:]
            return state[context]

        self.start = longest((bi,))
        self.unigram_state = [state.get((w,), 0) for w in range(min(bi, len(head.words)))]
        p_low: dict[tuple[int, int], float] = {}
        for context, s in state.items():  # shorter contexts first
            if not context:
                continue
            total = head.texts if context == (bi,) else int(head.counts[context[0]]) if len(context) == 1 else count[context[0] << _BITS | context[1]]
            self.fail[s] = longest(context[1:])
            seen = low = 0.0
            for w, c in follow[context]:
                p = (c - discount) / total
                seen += p
                low += float(uni[w]) if len(context) == 1 else self._p(p_low, context[1], w, uni, state)
                if len(context) == 1:
                    p_low[context[0], w] = p
                self.arcs[s << _BITS | w] = (math.log10(p), longest((context + (w,))[-2:]))
            self.back[s] = math.log10(max(1 - seen, 1e-12) / max(1 - low, 1e-12))
        self.all_back = [0.0] * len(state)  # down to the root
        for context, s in state.items():
            self.all_back[s] = self.back[s] + self.all_back[self.fail[s]]

    def _p(self, p_low: dict, v: int, w: int, uni: np.ndarray, state: dict) -> float:
        """Probability of w after v alone."""
        if (v, w) in p_low:
            return p_low[v, w]
        return float(uni[w]) * (10 ** self.back[state[v,]] if (v,) in state else 1.0)

    def score(self, ids: list[int], log10: list[float], bi: int) -> float:
        """Sum over head tokens of the text, and the backoff weights that other words (-1) cost."""
        arcs, back, fail, all_back, first = self.arcs.get, self.back, self.fail, self.all_back, self.unigram_state
        total, s = 0.0, self.start
        for w in ids:
            if w < 0 or w >= bi:
                if s:
                    total += all_back[s]
                    s = 0
                if w >= 0:
                    total += log10[w]
                continue
            while (arc := arcs(s << _BITS | w)) is None:
                if not s:
                    break
                total += back[s]
                s = fail[s]
            if arc is None:
                total += log10[w]
                s = first[w]
            else:
                total += arc[0]
                s = arc[1]
        return total


def _score(batches: Iterator[pa.RecordBatch], shared, grams, key: str, bi: int) -> Iterator[pa.RecordBatch]:
    head: Head = shared.value
    index = _kept(("head", key), head.index)
    automaton = _kept(("automaton", key), lambda: Automaton(head, *grams.value, bi))
    log10 = head.log10.tolist()
    look, end = index.get, index.get(END, -1)
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "times"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    for batch in batches:
        rows = []
        for doc, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = text.as_py().lower().split()
            ids = [look(w, -1) for w in words]
            tail = Counter(w for w, i in zip(words, ids) if i < 0) if -1 in ids else {}
            ids.append(end)
            if end < 0:
                tail[END] = 1
            at = np.array(ids)
            at = at[at >= 0]
            rows.append((doc, held, len(ids), len(at), float(head.log10[at].sum()), automaton.score(ids, log10, bi), list(tail), list(tail.values())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class WordKeys(dict):
    """64-bit names of words, each worked out once while it is known."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
        key = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)
        return key


#: Names of the end token, and of the beginning, which is no word: words hold no space.
END_KEY, BEGIN_KEY = WordKeys()[END], WordKeys()[b" "]
_ODD = np.uint64(0x9E3779B185EBCA87)


def gram_keys(pre: np.ndarray, suf: np.ndarray) -> np.ndarray:
    """Names of n-grams from those of their first and their last n - 1 words."""
    h = pre.view(np.uint64) * _ODD
    h = (h ^ h >> np.uint64(29)) + suf.view(np.uint64)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(29)) * _ODD
    return (h ^ h >> np.uint64(32)).view(np.int64)


def _grams(texts: list[bytes], keys: WordKeys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the word, pair and triple that end at each place, a row per place; its place in its text; the texts' starts."""
    ids: list[int] = []
    starts = []
    for text in texts:
        starts.append(len(ids))
        ids.append(BEGIN_KEY)
        ids += [keys[w] for w in text.lower().split()]
        ids.append(END_KEY)
    out = np.zeros((3, len(ids)), np.int64)
    out[0] = ids
    out[1, 1:] = gram_keys(out[0, :-1], out[0, 1:])
    out[2, 1:] = gram_keys(out[1, :-1], out[1, 1:])
    first = np.array(starts, np.int64)
    at = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return out, at, first


def _distinct(grams: np.ndarray, at: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the n-grams (n from 0): their places, the sorted distinct names of so many bits, the first place of each, and which each place has."""
    places = np.flatnonzero(at > max(0, n - 1))
    names, i, which = np.unique(grams[n, places].view(np.uint64) >> np.uint64(64 - bits), return_index=True, return_inverse=True)
    return places, names, places[i], which


CHUNKS = pa.schema([("chunk", pa.int64()), ("bytes", pa.int64()), ("learned", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("body", pa.binary())])
CHUNKS_DDL = "chunk long, bytes long, learned long, ids array<long>, held array<boolean>, lengths array<long>, body binary"
QUESTIONS = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("names", pa.list_(pa.binary())), ("times", pa.list_(pa.binary()))])
QUESTIONS_DDL = "block long, chunk long, names array<binary>, times array<binary>"
ANSWERS = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("words", pa.int64()), ("tokens", pa.int64()), ("counts", pa.list_(pa.binary())), ("owned", pa.list_(pa.binary()))])
ANSWERS_DDL = "block long, chunk long, words long, tokens long, counts array<binary>, owned array<binary>"
PASSED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
    ("words", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("context", pa.list_(pa.int64())), ("c", pa.list_(pa.int64())), ("p", pa.list_(pa.float64())), ("p_low", pa.list_(pa.float64())),
])
PASSED_DDL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<long>, keys array<long>, context array<long>, c array<long>, p array<double>, p_low array<double>"


def _chunks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    """The rows of a scan task by about ``tokens`` tokens; a chunk is named by the place of its first row."""
    made = TaskContext.get().partitionId() << 40
    ids, held, texts, size = [], [], [], 0

    def flush():
        body = b"".join(texts)
        row = (made, len(body), held.count(False), list(ids), list(held), list(map(len, texts)), zstandard.ZstdCompressor(level=3).compress(body))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, CHUNKS.types)], schema=CHUNKS)

    for batch in batches:
        for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            ids.append(doc)
            held.append(out)
            texts.append(text.as_py())
            size += len(texts[-1]) // 6 + 2
            if size >= tokens:
                yield from flush()
                made += len(ids)
                ids, held, texts, size = [], [], [], 0
    if ids:
        yield from flush()


def _texts(body: bytes, lengths: list[int]) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(body)
    ends = np.cumsum(lengths).tolist()
    return [whole[e - n : e] for e, n in zip(ends, lengths)]


def _ask(batches: Iterator[pa.RecordBatch], blocks: int, bits: int) -> Iterator[pa.RecordBatch]:
    """For each chunk and block the distinct words, pairs and triples named there, and how often training rows hold each."""
    keys = WordKeys()
    edges = np.array([i * (1 << bits) // blocks for i in range(1, blocks)], np.uint64)
    for batch in batches:
        for chunk, held, lengths, body in zip(*(batch.column(c) for c in ("chunk", "held", "lengths", "body"))):
            grams, at, first = _grams(_texts(body.as_py(), lengths.as_py()), keys)
            learned = np.repeat(~np.array(held.as_py(), bool), np.diff(np.append(first, len(at))))
            found = []
            for n in range(3):
                places, names, _, which = _distinct(grams, at, n, bits)
                times = np.bincount(which, weights=learned[places], minlength=len(names)).astype(np.int64)
                found.append((names, times, np.r_[0, np.searchsorted(names, edges), len(names)]))
            rows = []
            for b in range(blocks):
                own = [slice(cuts[b], cuts[b + 1]) for _, _, cuts in found]
                if any(x.stop > x.start for x in own):
                    rows.append((b, chunk.as_py(), [pack(f[0][x]) for f, x in zip(found, own)], [pack(f[1][x]) for f, x in zip(found, own)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), QUESTIONS.types)], schema=QUESTIONS)


def _answer(table: pa.Table) -> pa.Table:
    """To each question the counts over all training rows, for pairs and triples 0 in place of 1; each n-gram is one chunk's own.

    ``words`` and ``tokens``: the distinct training words that are the chunk's own, and their occurrences.
    """
    asked, times = table["names"].to_pylist(), table["times"].to_pylist()
    out = [[(), ()] for _ in asked]
    sums = [(0, 0)] * len(asked)
    for n in range(3):
        parts = [unpack(x[n], np.uint64) for x in asked]
        names, c = np.concatenate(parts), np.concatenate([unpack(x[n], np.int64) for x in times])
        order = np.argsort(names, kind="stable")
        new = np.r_[True, names[order][1:] != names[order][:-1]][: len(names)]
        total = np.add.reduceat(c[order], np.flatnonzero(new)) if len(names) else c
        count, own = np.empty_like(c), np.empty(len(c), bool)
        count[order], own[order] = total[np.cumsum(new) - 1], new
        if n:
            count[count < 2] = 0
        ends = np.cumsum(list(map(len, parts)))
        for i, (start, end) in enumerate(zip(ends - list(map(len, parts)), ends)):
            mine, some = own[start:end], count[start:end]
            out[i][0] += (pack(some),)
            out[i][1] += (pack(np.packbits(mine)),)
            if not n:
                sums[i] = (int((mine & (some > 0)).sum()), int(some[mine].sum()))
    columns = [table["block"], table["chunk"], *zip(*sums), *zip(*out)]
    return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, t) for x, t in zip(columns, ANSWERS.types)], schema=ANSWERS)


def _traverse(table: pa.Table, z: int, texts: int, bits: int) -> pa.Table:
    """One chunk's rows with the weights of the arcs taken, and the failure arcs that remain, of words and of pairs (keys); sums over its own arcs by context."""
    (chunk,) = table.filter(pc.is_valid(table["body"])).to_pylist()
    answers = table.filter(pc.is_null(table["body"])).sort_by("block")
    grams, at, first = _grams(_texts(chunk["body"], chunk["lengths"]), WordKeys())
    c, own = np.zeros(grams.shape, np.int64), np.zeros(grams.shape, bool)
    counts, owned = answers["counts"].to_pylist(), answers["owned"].to_pylist()
    for n in range(3):
        places, _, firsts, which = _distinct(grams, at, n, bits)
        parts = [unpack(x[n], np.int64) for x in counts]
        mine = [np.unpackbits(unpack(x[n], np.uint8), count=len(some)) for x, some in zip(owned, parts)]
        c[n, places] = np.concatenate(parts)[which] if len(places) else 0
        own[n, firsts] = np.concatenate(mine).astype(bool)
    c[0, first] = texts  # how often a text begins
    before, context = np.roll(c, 1, axis=1), np.roll(grams, 1, axis=1)
    p = np.zeros(c.shape)
    p[0] = (c[0] + 1) / z
    arc = c[1:] > 1
    p[1:][arc] = (c[1:][arc] - DISCOUNT) / before[:2][arc]
    word = at > 0
    taken = np.where(arc[1], p[2], np.where(arc[0], p[1], p[0]))
    fails = [word & ~arc[0] & ~arc[1] & (before[0] > 1), (at > 1) & ~arc[1] & (before[1] > 1)]
    lengths = np.diff(np.append(first, len(at))) - 1
    add = lambda values: np.add.reduceat(values, first)
    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(add(x.astype(np.int64)))).astype(np.int32)), pa.array(context[n, x])) for n, x in enumerate(fails)]
    m, nulls = len(first), lambda t: pa.nulls(len(first), t)
    rows = pa.table([
        pa.array(chunk["chunk"] + np.arange(m)), pa.array(chunk["ids"], pa.int64()), pa.array(chunk["held"], pa.bool_()), pa.array(lengths),
        pa.array(add((word & (c[0] > 0)).astype(np.int64))), pa.array(add(np.where(word, np.log10(p[0]), 0.0))), pa.array(add(np.where(word, np.log10(taken), 0.0))),
        *lists, *(nulls(t) for t in PASSED.types[9:]),
    ], schema=PASSED)
    sums = [own[1:][n] & arc[n] for n in (0, 1)]
    name = np.concatenate([context[n, x] for n, x in enumerate(sums)])
    of, i, which = np.unique(name, return_index=True, return_inverse=True)
    high, low = (np.bincount(which, weights=np.concatenate([p[n + up, x] for n, x in enumerate(sums)]), minlength=len(of)) for up in (1, 0))
    c_of = np.concatenate([before[n, x] for n, x in enumerate(sums)])[i]
    arcs = pa.table([pa.nulls(1, t) for t in PASSED.types[:9]] + [pa.array([x], t) for x, t in zip((of, c_of, high, low), PASSED.types[9:])], schema=PASSED)
    return pa.concat_tables([rows, arcs])


FAILURES = pa.schema([("block", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("rows", pa.binary())])
FAILURES_DDL = "block long, batch long, keys binary, rows binary"
WEIGHED = pa.schema([("batch", pa.int64()), ("rows", pa.binary()), ("sums", pa.binary())])
WEIGHED_DDL = "batch long, rows binary, sums binary"
SUMS = pa.schema([("row", pa.int64()), ("more", pa.float64())])


def _look_up(names: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in the sorted names, and which are there."""
    i = np.minimum(np.searchsorted(names, keys), max(0, len(names) - 1))
    return i, names[i] == keys if len(names) else np.zeros(len(keys), bool)


def _sum_by(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of, which = np.unique(rows, return_inverse=True)
    return of, np.bincount(which, weights=values, minlength=len(of))


def _hot_failures(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Adds the failure weights of contexts in the hot head; keys are those of other contexts."""
    hot, back = shared.value
    for batch in batches:
        if not batch.num_rows:
            continue
        lists, n = [batch.column(x) for x in ("words", "keys")], batch.num_rows
        keys = np.concatenate([x.flatten().to_numpy() for x in lists])
        row = np.concatenate([np.repeat(np.arange(n), pc.list_value_length(x).to_numpy()) for x in lists])
        by_row = np.argsort(row, kind="stable")
        keys, row = keys[by_row], row[by_row]
        i, found = _look_up(hot, keys)
        more = np.bincount(row[found], weights=back[i[found]], minlength=n)
        left = np.append(0, np.cumsum(np.bincount(row[~found], minlength=n))).astype(np.int32)
        columns = {c: batch.column(c) for c in batch.schema.names if c != "words"} | {"score": pa.array(batch.column("score").to_numpy() + more), "keys": pa.ListArray.from_arrays(pa.array(left), pa.array(keys[~found]))}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _ask_failures(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """For each batch of rows and block the contexts there that failure arcs are left of, and the row of each; a batch is named by its first row."""
    for batch in batches:
        lists, row = batch.column("keys"), batch.column("row").to_numpy()
        keys = lists.flatten().to_numpy().view(np.uint64)
        if not len(keys):
            continue
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], np.repeat(row, pc.list_value_length(lists).to_numpy())[order]
        block = ((keys >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        own = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(keys)])]
        columns = [block[starts], np.full(len(starts), row[0]), [pack(keys[x]) for x in own], [pack(rows[x]) for x in own]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FAILURES.types)], schema=FAILURES)


def _weigh(asked: pa.Table, known: pa.Table) -> pa.Table:
    """To each question of a block the sum of the failure weights by row; contexts without arcs have none."""
    names, back = known["key"].to_numpy().view(np.uint64), known["back"].to_numpy()
    order = np.argsort(names)
    names, back = names[order], back[order]
    out = []
    for batch, keys, rows in zip(*(asked[c].to_pylist() for c in ("batch", "keys", "rows"))):
        i, found = _look_up(names, unpack(keys, np.uint64))
        if found.any():
            of, sums = _sum_by(unpack(rows, np.int64)[found], back[i[found]])
            out.append((batch, pack(of.view(np.uint64)), pack(sums)))
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, WEIGHED.types)], schema=WEIGHED)


def _sum_weighed(table: pa.Table) -> pa.Table:
    rows, sums = (np.concatenate([unpack(x, kind) for x in table[c].to_pylist()]) for c, kind in (("rows", np.uint64), ("sums", np.float64)))
    of, more = _sum_by(rows.view(np.int64), sums)
    return pa.table([pa.array(of), pa.array(more)], schema=SUMS)


def score(docs: DataFrame, modulus: int = 7, held_remainder: int = 2, hot: int = HOT, chunk_tokens: int = CHUNK_TOKENS, **bounds: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from the rows whose crc32(doc_id as text) leaves another remainder than ``held_remainder``. ``bounds``
    are those of ``score_bounded``, which they call for.
    """
    if bounds:
        return score_bounded(docs, modulus, held_remainder, **bounds)
    spark = docs.sparkSession
    small_batches(spark)
    held = id_remainder(modulus) == held_remainder
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_bytes())
    chunks = materialise(chosen.mapInArrow(partial(_chunks, tokens=chunk_tokens), CHUNKS_DDL), "lm-chunks")
    size, texts = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("learned"), F.lit(0))).first()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    bits = min(64, int(size).bit_length() + SPARE_BITS)
    asked = chunks.mapInArrow(partial(_ask, blocks=blocks, bits=bits), QUESTIONS_DDL)
    answers = materialise(asked.groupBy("block").applyInArrow(lambda table: _answer(table), ANSWERS_DDL), "lm-answers")
    settle(spark)  # the questions, the most that is on disk at once
    distinct, tokens = answers.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    z = tokens + distinct + 1
    both = chunks.drop("bytes", "learned").unionByName(answers.drop("words", "tokens"), allowMissingColumns=True)
    passed = materialise(both.groupBy("chunk").applyInArrow(lambda table: _traverse(table, z=z, texts=texts, bits=bits), PASSED_DDL), "lm-passed")
    discard(chunks, answers)
    settle(spark)
    arcs = passed.where("context is not null").select(F.explode(F.arrays_zip("context", "c", "p", "p_low")).alias("a")).select("a.*")
    left = lambda p: F.greatest(1 - F.sum(p), F.lit(1e-12))
    backs = arcs.groupBy(F.col("context").alias("key")).agg(F.max("c").alias("c"), F.log10(left("p") / left("p_low")).alias("back"))
    backs = materialise(backs, "lm-backs")
    settle(spark)
    least = _at_most(backs, hot)
    top = backs.where(F.col("c") >= least).select("key", "back").orderBy("key").toArrow()
    shared = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("key", "back")))

    rows = passed.where("row is not null").select("row", "doc_id", "held_out", "n_tokens", "n_known", F.col("base").alias("base_score"), "score", "words", "keys")
    rows = materialise(rows.mapInArrow(partial(_hot_failures, shared=shared), rows.drop("words").schema), "lm-scored")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-backs.count() // BLOCK_CONTEXTS))
    rare = backs.where(F.col("c") < least).select("key", "back", F.shiftright(F.shiftrightunsigned("key", 40) * F.lit(parts), 24).alias("block"))
    left_of = rows.select("row", "keys").mapInArrow(partial(_ask_failures, blocks=parts), FAILURES_DDL)
    weighed = left_of.groupBy("block").cogroup(rare.groupBy("block")).applyInArrow(lambda asked, known: _weigh(asked, known), WEIGHED_DDL)
    sums = weighed.groupBy("batch").applyInArrow(lambda table: _sum_weighed(table), "row long, more double")
    discard(passed)
    return rows.drop("keys").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def score_bounded(docs: DataFrame, modulus: int = 7, held_remainder: int = 2, head: int = HEAD, bigram_words: int = BIGRAM_WORDS, trigram_words: int = TRIGRAM_WORDS, max_grams: int = MAX_GRAMS) -> DataFrame:
    """``score`` by a model that every task holds, cut to the bounds."""
    spark = docs.sparkSession
    small_batches(spark)
    held = id_remainder(modulus) == held_remainder
    train = docs.where(~held).select(text_bytes())
    counts = materialise(train.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    distinct, tokens, texts = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))).first()
    least = _at_most(counts, head)
    top = counts.where(F.col("c") >= least).toArrow()
    words, c = top.column("word").to_pylist(), top.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    key = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(Head([words[i] for i in order], c[np.array(order, int)].astype(np.int64), tokens, distinct, texts))
    bi = min(bigram_words, len(words))
    found = train.mapInArrow(partial(_count_grams, shared=shared, key=key, bi=bi, tri=trigram_words), "gram long, c long")
    found = materialise(found.groupBy("gram").agg(F.sum("c").alias("c")).where("c > 1"), "lm-grams")
    kept = found.where(F.col("c") >= _at_most(found, max_grams)).orderBy("gram").toArrow()
    grams = spark.sparkContext.broadcast((kept.column("gram").to_numpy(), kept.column("c").to_numpy()))
    discard(found)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_bytes())
    ddl = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<binary>, times array<long>"
    passed = chosen.mapInArrow(partial(_score, shared=shared, grams=grams, key=key, bi=bi), ddl)
    passed = materialise(passed.withColumn("row", F.monotonically_increasing_id()), "lm-passed")
    tail = passed.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
    rare = counts.where(F.col("c") < least)
    c = F.coalesce(F.col("c"), F.lit(0))
    log10 = F.log10((c + 1) / F.lit(float(tokens + distinct + 1)))
    sums = tail.join(rare, "word", "left").groupBy("row").agg(F.sum(F.col("times") * log10).alias("tail"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    more = F.coalesce(F.col("tail"), F.lit(0.0))
    return passed.drop("words", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
