"""Phrase collocations from an FM-index per shard over word ids.

A scan task gathers the words of each language into shards and indexes each: the Burrows-Wheeler transform of its word
ids and that of the ids reversed, in the order of the next ``LONGEST`` words, which is all that phrases of that length
ask for. A phrase is a pair of intervals, one in either order. Extending it to the left by a word is a rank query on
the transform; the reversed interval follows by counting smaller words. Breaks between pieces are a symbol of their
own, so how often a phrase has a word on its left or right is the interval's size less the breaks in it, in either
transform; as phrases grow to the left alone, of the reversed transform only the places of its breaks are kept.

Phrases grow a word at a time. Shards report their counts of phrases whose two halves (all but the last word, all but
the first) are frequent over all shards; a window by phrase sums them, and each shard is told which of its own are
frequent. So only what can be a candidate is ever shuffled, a phrase at most once per shard. Whole words are named by
the shard and place of their first report, hence exactly. Reports of longer phrases are packed, a row per shard and block of
phrases; a block's task sums them and answers each row with a bit per report.

Defined results: null text is empty; a null lang is ``und``; repeated rows count each; ties in a score go to the shorter
first part, ties in rank to the larger count, then to the phrase in order of its UTF-8 bytes; an empty table gives no
rows; a text of any length counts whole; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches as packed_rows
from .common import discard, materialise, pack, settle, small_batches, unpack

LONGEST = 4
LEAST = 30
TOP = 2000
#: A candidate goes when a longer one that holds it is at least this many fifths as frequent.
HELD_FIFTHS = 4
SCALE = 2_000_000
#: Words that a task holds before it indexes the largest of its shards.
SHARD_WORDS = 1 << 22
#: Words of all texts per block of phrases.
BLOCK_WORDS = 1 << 22
#: Parts that the best phrases of a language are chosen in first.
PARTS = 64

BREAK, NOTHING = 0, 1
_MAP = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: Bits of a word's name: those of its place, and of the shard's place in its task.
PLACE_BITS, SHARD_BITS = 29, 10

SHARD = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("bwt", pa.binary()), ("reversed_breaks", pa.binary())])
SHARD_DDL = "shard long, lang string, n_words long, words array<string>, counts array<long>, bwt binary, reversed_breaks binary"


def transform(ids: np.ndarray) -> np.ndarray:
    """The symbol before each place, in order of the next four symbols; the sequence is a ring."""
    pair = ids.astype(np.int64) * (int(ids.max()) + 1) + np.roll(ids, -1)
    _, rank = np.unique(pair, return_inverse=True)
    four = rank.astype(np.int64) * (int(rank.max()) + 1) + np.roll(rank, -2)
    return np.roll(ids, 1)[np.argsort(four, kind="stable")].astype(np.uint32)


class Breaks:
    """How many breaks are before each place of a transform."""

    def __init__(self, broken: np.ndarray):
        self.before = np.concatenate([[0], np.cumsum(broken, dtype=np.int64)])

    def unbroken(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """At how many places of each interval a word, not a break, comes before."""
        return size - (self.before[start + size] - self.before[start])


class Index:
    """Rank queries on a transform."""

    def __init__(self, bwt: np.ndarray):
        self.bwt, self.n = bwt, len(bwt)

    @cached_property
    def places(self) -> np.ndarray:
        """Symbol and place of each entry as one number, in order."""
        order = np.argsort(self.bwt, kind="stable")
        return self.bwt[order].astype(np.int64) * self.n + order

    def start(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the interval of the symbol and then the interval that starts at the place starts."""
        return np.searchsorted(self.places, symbol * self.n + place)


def extend(index: Index, start: np.ndarray, size: np.ndarray, reversed_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """All extensions to the left by a word: (phrase extended, word, start, size, start in the reversed order)."""
    n = int(size.sum())
    before = np.cumsum(size) - size
    rows = np.arange(n) + np.repeat(start - before, size)
    width = int(index.bwt.max()) + 1 if index.n else 1
    keys, sizes = np.unique(np.repeat(np.arange(len(start)), size) * width + index.bwt[rows], return_counts=True)
    phrase, word = np.divmod(keys, width)
    smaller = np.cumsum(sizes) - sizes - before[phrase]
    found = word > NOTHING
    phrase, word, sizes, smaller = phrase[found], word[found], sizes[found], smaller[found]
    return phrase, word, index.start(word, start[phrase]), sizes, reversed_start[phrase] + smaller


class _Shard:
    def __init__(self):
        self.ids: defaultdict = defaultdict()
        self.ids.update({b"\n": BREAK, b"": NOTHING})
        self.ids.default_factory = self.ids.__len__
        self.parts: list[np.ndarray] = [np.array([BREAK], np.int32)]
        self.n = 0

    def add(self, text: str) -> int:
        """The words of a text, then a break; how many symbols that made."""
        raw = text.encode().lower().translate(_MAP)
        at, before = 0, self.n
        while at < len(raw):  # a very long text goes in slices, cut at a space
            to = raw.find(b" ", at + (1 << 20))
            tokens = raw[at : to if to > 0 else len(raw)].replace(b"\n", b" \n ").split(b" ")
            at = to if to > 0 else len(raw)
            ids = np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens))
            self.parts.append(ids[ids != NOTHING])
            self.n += len(self.parts[-1])
        self.parts.append(np.array([BREAK], np.int32))
        return self.n - before

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.ids))[NOTHING + 1 :]
        words = [w.decode() for w in self.ids][NOTHING + 1 :]
        columns = [[number], [lang], [int(counts.sum())], [words], [counts], [pack(transform(ids))], [pack(np.packbits(transform(ids[::-1]) == BREAK))]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SHARD.types)], schema=SHARD)


def _index(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    number, held, total = TaskContext.get().partitionId() << SHARD_BITS, {}, 0
    last = number + (1 << SHARD_BITS)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            total += held.setdefault(lang, _Shard()).add(text)
            if total >= shard_words:
                lang = max(held, key=lambda x: held[x].n)
                shard = held.pop(lang)
                total -= shard.n
                yield shard.row(number, lang)
                number += 1
                if number == last:
                    raise ValueError("a scan task holds too many shards: raise SHARD_WORDS or cut the input finer")
    for lang, shard in held.items():
        yield shard.row(number, lang)
        number += 1
        if number > last:
            raise ValueError("a scan task holds too many shards: raise SHARD_WORDS or cut the input finer")


def index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The shards: their words with counts, and both transforms."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return materialise(chosen.mapInArrow(partial(_index, shard_words=shard_words), SHARD_DDL), "phrases-shards")


REPORTS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("words", pa.list_(pa.binary())), ("sums", pa.list_(pa.binary()))])
REPORTS_DDL = "block long, shard long, words array<binary>, sums array<binary>"
SUMS = ["n", "left", "right"]


def _blocks(words: list[np.ndarray], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases, given by the names of their words, in order of their blocks; and where each block starts."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w.view(np.uint64)) * np.uint64(0x9E3779B185EBCA87)
        h ^= h >> np.uint64(29)
    block = (h % np.uint64(blocks)).astype(np.int64)
    return np.argsort(block, kind="stable"), np.append(0, np.cumsum(np.bincount(block, minlength=blocks)))


def _extend(batches: Iterator[pa.RecordBatch], length: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard and block: the phrases of a length whose halves are frequent by the names of their words, and their counts.

    Shorter phrases are found anew, in the same order, and those that the shard was told of go on; that costs less than
    to store them.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            value = lambda name: batch.column(name)[i]  # noqa: B023, E731
            index = Index(unpack(value("bwt").as_py(), np.uint32))
            forward = Breaks(index.bwt == BREAK)
            backward = Breaks(np.unpackbits(unpack(value("reversed_breaks").as_py(), np.uint8), count=index.n))
            known = value("known").values
            word = known.field("place").to_numpy() + NOTHING + 1
            names = np.full(int(index.bwt.max()) + 1, -1, np.int64)
            names[word] = known.field("name").to_numpy()
            word = np.sort(word)
            size = np.bincount(index.bwt, minlength=len(names))
            start = reversed_start = (np.cumsum(size) - size)[word]
            size, words = size[word], [word]
            for now in range(2, length + 1):
                phrase, word, begins, n, reversed_begins = extend(index, start, size, reversed_start)
                good = names[word] >= 0
                if now > 2:  # the phrase without its last word starts where it does
                    at = np.searchsorted(start, begins, side="right") - 1
                    good &= (at >= 0) & (begins < start[at] + size[at])
                places = np.flatnonzero(good)
                if now < length:
                    order, edges = _blocks([names[word[places]], *(names[w[phrase[places]]] for w in words)], blocks)
                    told = np.zeros(len(places), bool)
                    for x in value(f"told{now}").as_py():
                        own = order[edges[x["block"]] : edges[x["block"] + 1]]
                        told[own] = np.unpackbits(np.frombuffer(x["told"], np.uint8), count=len(own))
                    places = places[told]
                    places = places[np.argsort(begins[places])]
                words = [word[places], *(w[phrase[places]] for w in words)]
                start, size, reversed_start = begins[places], n[places], reversed_begins[places]
            words = [names[w] for w in words]
            order, edges = _blocks(words, blocks)
            words = [w[order] for w in words]
            # of the sides the breaks, which are few
            sums = [x[order] for x in (size, size - forward.unbroken(start, size), size - backward.unbroken(reversed_start, size))]
            rows = [(b, value("shard").as_py(), *([pack(x[edges[b] : edges[b + 1]]) for x in columns] for columns in (words, sums))) for b in np.flatnonzero(np.diff(edges)).tolist()]
            yield from packed_rows(REPORTS, rows)


def _sum(table: pa.Table, least: int, schema: pa.Schema) -> pa.Table:
    """The phrases of a block that all shards together hold often enough, with their sums; and to each shard which of its own these are."""
    words, sums = ([np.concatenate(x) for x in zip(*([unpack(p, np.int64) for p in row] for row in table[c].to_pylist()))] for c in ("words", "sums"))
    order = np.lexsort(words)
    words = [w[order] for w in words]
    new = np.append(True, reduce(np.logical_or, [w[1:] != w[:-1] for w in words]))
    first = np.flatnonzero(new)
    n, left, right = (np.add.reduceat(x[order], first) for x in sums)
    good = n >= least
    told = np.empty(len(order), bool)
    told[order] = good[np.cumsum(new) - 1]
    ends = np.cumsum([len(unpack(row[0], np.int64)) for row in table["sums"].to_pylist()])
    bits = [np.packbits(x).tobytes() if x.any() else None for x in np.split(told, ends[:-1])]
    answers = pa.table([table["shard"].combine_chunks(), table["block"].combine_chunks(), pa.array(bits, pa.binary()), *(pa.nulls(len(bits), t) for t in schema.types[3:])], schema=schema)
    frequent = [w[first][good] for w in words] + [x[good] for x in (n, n - left, n - right)]
    phrases = pa.table([*(pa.nulls(int(good.sum()), t) for t in schema.types[:3]), *(pa.array(x) for x in frequent)], schema=schema)
    return pa.concat_tables([answers.filter(pc.is_valid(answers["told"])), phrases])


def _summed(least: int, schema: pa.Schema):
    return lambda table: _sum(table, least, schema)


def _report(shard: str, place: Column) -> Column:
    return (F.shiftleft(F.col(shard), PLACE_BITS) + place).alias("report")


def _frequent(rows: DataFrame, keys: list[str], sums: list[str], least: int) -> DataFrame:
    """Reports of phrases that all shards together hold often enough, with the sums and the phrase's first report."""
    same = Window.partitionBy(*keys)
    total = rows.select("report", *keys, *[F.sum(c).over(same).alias(c) for c in sums], F.min("report").over(same).alias("name"))
    return total.where(F.col(sums[0]) >= least)


def grams(shards: DataFrame, least: int = LEAST) -> list[DataFrame]:
    """Frequent phrases of one to LONGEST words. Of words: lang, word, name, n; of longer ones: w1.. (names), n, left, right."""
    spark = shards.sparkSession
    rows = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select(_report("shard", F.col("place")), "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    place, shard = F.col("report").bitwiseAND((1 << PLACE_BITS) - 1), F.shiftright("report", PLACE_BITS).alias("shard")
    found = materialise(_frequent(rows, ["lang", "word"], ["n"], least), "phrases-found")
    out = [materialise(found.where("report = name").select("lang", "word", "name", "n"), "phrases-frequent")]
    told = materialise(found.groupBy(shard).agg(F.collect_list(F.struct(place.alias("place"), "name")).alias("known")), "phrases-told")
    discard(found)
    settle(spark)
    base = shards.select("shard", "bwt", "reversed_breaks").join(told, "shard")
    total = shards.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_WORDS))
    for length in range(2, LONGEST + 1):
        names = [f"w{i}" for i in range(1, length + 1)]
        schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("told", pa.binary()), *((c, pa.int64()) for c in names + SUMS)])
        ddl = ", ".join(f"`{c}` {'binary' if c == 'told' else 'long'}" for c in schema.names)
        rows = base.mapInArrow(partial(_extend, length=length, blocks=blocks), REPORTS_DDL)
        found = materialise(rows.groupBy("block").applyInArrow(_summed(least, schema), ddl), "phrases-found")
        out.append(materialise(found.where("told is null").select(*names, *SUMS), "phrases-frequent"))
        if length < LONGEST:
            told = found.where("told is not null").groupBy("shard").agg(F.collect_list(F.struct("block", "told")).alias(f"told{length}"))
            base = base.join(materialise(told, "phrases-told"), "shard")
        discard(found)
        settle(spark)
    return out


def _cuts(counts: list[tuple[Column, Column]]) -> Column:
    """The lowest score of the cuts (count of the first part, of the rest), ties to the first; floors are exact."""
    scored = []
    for k, (first, rest) in enumerate(counts, 1):
        score = F.call_function("div", F.col("n").cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(8,0)"), (first + rest).cast("decimal(20,0)"))
        scored.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("cut"), first.alias("l"), rest.alias("r")))
    return F.least(*scored) if len(scored) > 1 else scored[0]


def _ends(table: DataFrame, keys: list[str], to: list[str], columns: dict[str, str]) -> DataFrame:
    """A table of shorter phrases, its keys and columns renamed for a join."""
    return table.select(*[F.col(a).alias(b) for a, b in zip(keys, to)], *[F.col(a).alias(b) for a, b in columns.items()])


def _free(table: DataFrame, longer: DataFrame | None, keys: list[str]) -> DataFrame:
    """The phrases that no frequent phrase of a word more holds too often; phrases longer still are rarer."""
    if longer is None:
        return table
    more = [f"w{i}" for i in range(1, len(keys) + 2)]
    parts = reduce(DataFrame.unionByName, [_ends(longer, own, keys, {"n": "held"}) for own in (more[:-1], more[1:])])
    most = parts.groupBy(*keys).agg(F.max("held").alias("held"))
    return table.join(most, keys, "left").where(~F.coalesce(5 * F.col("held") >= HELD_FIFTHS * F.col("n"), F.lit(False))).drop("held")


def candidates(found: list[DataFrame]) -> DataFrame:
    """w1.. w4, length, lang, n, left, right, score, cut, l, r of the phrases that remain."""
    words, two, three, four = found
    two = two.join(_ends(words, ["name"], ["w1"], {"n": "n1", "lang": "lang"}), "w1").join(_ends(words, ["name"], ["w2"], {"n": "n2"}), "w2")
    two = materialise(two, "phrases-two")
    three = three.join(_ends(two, ["w1", "w2"], ["w1", "w2"], {"n": "n12", "n1": "n1", "lang": "lang"}), ["w1", "w2"])
    three = materialise(three.join(_ends(two, ["w1", "w2"], ["w2", "w3"], {"n": "n23", "n2": "n3"}), ["w2", "w3"]), "phrases-three")
    four = four.join(_ends(three, ["w1", "w2", "w3"], ["w1", "w2", "w3"], {"n": "n123", "n12": "n12", "n1": "n1", "lang": "lang"}), ["w1", "w2", "w3"])
    four = four.join(_ends(three, ["w1", "w2", "w3"], ["w2", "w3", "w4"], {"n": "n234", "n23": "n34", "n3": "n4"}), ["w2", "w3", "w4"])
    c = F.col
    cuts = [[(c("n1"), c("n2"))], [(c("n1"), c("n23")), (c("n12"), c("n3"))], [(c("n1"), c("n234")), (c("n12"), c("n34")), (c("n123"), c("n4"))]]
    out = []
    for table, longer, length, own in zip((two, three, four), (three, four, None), (2, 3, 4), cuts):
        kept = _free(table, longer, [f"w{i}" for i in range(1, length + 1)])
        names = [c(f"w{i}") if i <= length else F.lit(None).cast("long").alias(f"w{i}") for i in range(1, LONGEST + 1)]
        out.append(kept.select(*names, F.lit(length).alias("length"), "lang", "n", "left", "right", _cuts(own).alias("s")))
    return reduce(DataFrame.unionByName, out).select("*", "s.*").drop("s")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, and how often a word of the same piece stands left and right of the phrase."""
    shards = index(docs, shard_words)
    totals = shards.groupBy("lang").agg(F.sum("n_words").alias("total"))
    found = grams(shards, least)
    names = [f"w{i}" for i in range(1, LONGEST + 1)]
    best = [F.desc("score"), F.desc("n")]
    chosen = candidates(found).withColumn("part", F.pmod(F.xxhash64(*names), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):  # ties stay until the phrases are known
        chosen = chosen.withColumn("at", F.rank().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("at") <= top)
    chosen = materialise(chosen.drop("at", "part"), "phrases-chosen")
    spelt = chosen.select(F.struct(*names).alias("key"), F.posexplode(F.array_compact(F.array(*names))).alias("place", "name")).join(found[0].select("name", "word"), "name")
    spelt = spelt.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = chosen.withColumn("key", F.struct(*names)).join(spelt, "key").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase"))
    ranked = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score", F.col("left").alias("left_words"), F.col("right").alias("right_words"))
