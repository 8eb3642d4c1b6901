"""Language identification by cross-parsing entropy.

Per language, a suffix automaton is built over a bounded sample of labelled words. A text's words are parsed
greedily: each phrase is the longest match that the automaton allows, and a character that matches nothing is
a phrase by itself. The language whose phrases cost the fewest bits per character (phrases times the log of its
sample size) wins; ties go to the smaller language name. Words begin with a boundary mark and phrases do not
run over it, so equal words cost the same and are parsed once per worker. Case and all but letters are dropped.

Defined results: ``und`` with score 0 if the text is null or has no letter, or nothing was learned; repeated
rows are predicted once each; an empty table gives no rows; texts of any length are parsed whole.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_remainder, materialise, small_batches

#: The bound of the fit: code points of labelled text per language.
SAMPLE_CHARS = 40_000
#: Parts of a language's rows by hash, in whose order the sample is filled.
BUCKETS = 1 << 16
#: Words of one worker whose phrase counts are kept; then it starts anew.
CACHE = 300_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
DDL = "doc_id long, held_out boolean, lang_pred string, score double"


class SuffixAutomaton:
    """Transitions in one flat dict, keyed by state * 2**21 + code point."""

    def __init__(self, text: str):
        go: dict[int, int] = {}
        own: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in map(ord, text):
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            own.append({})
            p = last
            while p != -1 and c not in own[p]:
                own[p][c] = cur
                p = link[p]
            if p != -1:
                q = own[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    own.append(dict(own[q]))
                    while p != -1 and own[p].get(c) == q:
                        own[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        for state, edges in enumerate(own):
            for c, to in edges.items():
                go[state << 21 | c] = to
        self.go = go
        self.size = max(2, len(text))

    def phrases(self, text: str) -> int:
        """Greedy longest-match phrases that cover the text."""
        go, state, n = self.go, 0, 0
        for c in map(ord, text):
            to = go.get(state << 21 | c)
            if to is None:
                n += 1  # the phrase before ends here
                to = go.get(c)
                if state == 0 or to is None:
                    n += to is None and state != 0  # an unknown character is a phrase too
                    state = 0 if to is None else to
                    continue
            state = to
        return n + (state != 0)


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _leading(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """The leading words of each text, letters only, until ``chars`` code points are reached."""
    for batch in batches:
        out = []
        for text in batch.column(2):
            own, size = [], 0
            for w in filter(None, map(letters, text.as_py().lower().split())):
                own.append(w)
                size += len(w) + 1
                if size >= chars:
                    break
            out.append(" ".join(own))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["lang", "at", "text"])


def sample(docs: DataFrame, held_out, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Words of labelled rows for every language, row by row in order of a hash until ``chars`` code points are reached."""
    rows = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(BUCKETS)).alias("at"), "text")
    size = F.sum(F.least(F.char_length("text"), F.lit(chars))).alias("size")
    sizes = materialise(rows.groupBy("lang", "at").agg(size), "langid-sizes")
    so_far = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("lang").orderBy("at")) - F.col("size"))
    wanted = 2 * chars
    while True:
        upto = so_far.groupBy("lang").agg(F.max(F.when(F.col("before") < wanted, F.col("at"))).alias("upto"), F.max("at").alias("last"))
        upto = materialise(upto, "langid-upto")
        some = rows.join(F.broadcast(upto), "lang").where("at <= upto").select("lang", "at", "text")
        found: dict[str, list[str]] = {}
        have: dict[str, int] = {}
        for r in some.mapInArrow(partial(_leading, chars=chars), "lang string, at long, text string").orderBy("at", "text").toLocalIterator():
            for w in r["text"].split():
                if have.get(r["lang"], 0) >= chars:
                    break
                found.setdefault(r["lang"], []).append(w)
                have[r["lang"]] = have.get(r["lang"], 0) + len(w) + 1
        more = any(have.get(r["lang"], 0) < chars for r in upto.where("upto < last").select("lang").toLocalIterator())
        discard(upto)
        if not more:
            discard(sizes)
            return {la: " " + " ".join(w) for la, w in sorted(found.items())}
        wanted *= 4  # texts with few letters


_models: dict[str, tuple] = {}


def _automata(key: str, samples: dict[str, str]) -> tuple:
    if key not in _models:
        _models.clear()
        built = [SuffixAutomaton(t) for t in samples.values()]
        _models[key] = (list(samples), built, np.array([math.log2(a.size) for a in built]), {}, [])
    return _models[key]


def _predict(batches: Iterator[pa.RecordBatch], key: str, shared) -> Iterator[pa.RecordBatch]:
    names, automata, bits, known, costs = _automata(key, shared.value)
    look = known.get
    for batch in batches:
        rows = []
        for doc, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py() or ""
            if not names or not any(map(str.isalpha, text)):
                rows.append((doc, held, "und", 0.0))
                continue
            if len(known) > CACHE:
                known.clear()
                costs.clear()
            at = []
            for w in text.lower().split():
                i = look(w)
                if i is None:
                    i = known[w] = len(costs)
                    own = letters(w)
                    costs.append([*(a.phrases(" " + own) if own else 0 for a in automata), len(own)])
                at.append(i)
            sums = np.array([costs[i] for i in at], np.int64).sum(0)
            total = sums[:-1] * bits / max(1, sums[-1])
            best = int(total.argmin())
            odds = np.exp(-8.0 * (total - total[best]))
            rows.append((doc, held, names[best], float(1 / odds.sum())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)


def identify(docs: DataFrame, modulus: int = 3, held_remainder: int = 1, chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from labelled rows that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    held = id_remainder(modulus) == held_remainder
    samples = sample(docs, held, chars)
    shared = spark.sparkContext.broadcast(samples)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text"))
    return chosen.mapInArrow(partial(_predict, key=uuid.uuid4().hex, shared=shared), DDL)
