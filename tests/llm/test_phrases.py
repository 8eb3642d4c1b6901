"""Phrase collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorebook.llm import phrases
from tests.llm.test_operators import DOCS, docs, empty, rows  # noqa: F401


def pieces(text) -> list[list[str]]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(data: list[tuple], least: int, top: int) -> list[tuple]:
    """data: (lang, text)."""
    f, sides, n = defaultdict(Counter), defaultdict(Counter), Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    g = tuple(w[i : i + k])
                    f[lang][g] += 1
                    sides[lang][g, "left"] += i > 0
                    sides[lang][g, "right"] += i + k < len(w)
    out = []
    for lang, count in f.items():
        cand = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in cand.items():
            longer = [b for h, b in cand.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2_000_000 * a // (count[g[:k]] + count[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), g, k))
        for rank, (score, a, _, g, k) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, " ".join(g), -a, count[g[:k]], count[g[k:]], n[lang], -score, sides[lang][g, "left"], sides[lang][g, "right"]))
    return sorted(out)


def found(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def texts():
    """Few words, so that phrases repeat; passages, odd spaces, breaks, capitals and other scripts."""
    r = random.Random(11)
    pool = "tree stone river cloud a The the of OF é ß 中 x-y don't \x1f\xa0q".split(" ")
    passages = [" ".join(r.choices(pool, k=r.randint(4, 9))) for _ in range(8)]
    out = []
    for i in range(400):
        parts = [r.choice([r.choice(passages), " ".join(r.choices(pool, k=r.randint(0, 7)))]) for _ in range(r.randint(0, 6))]
        out.append((i, r.choice(["en", "en", "de", None, "und"]), r.choice(["  ", ". ", "\n", "\t", ", ", ";", " "]).join(parts)))
    return [*out, (900, "en", None), (901, "en", ""), (902, "fr", "..!?"), (903, "en", "\n".join([passages[0]] * 500)), out[3], out[3], (None, "en", "no id " * 40), (904, "zz", "same " * 90)]


@pytest.mark.parametrize(("least", "top", "shard"), [(30, 2000, phrases.SHARD_WORDS), (5, 2000, 300), (2, 40, 150), (3, 7, 1)])
def test_collocations(spark, texts, least, top, shard):
    """Small shards, so that counts of a phrase meet from many."""
    df = spark.createDataFrame([(*t, 1, "c") for t in texts], "doc_id long, lang string, text string, n int, word string").repartition(3)
    want = brute([t[1:] for t in texts], least, top)
    got = found(phrases.collocations(df, least, top, shard))
    assert want and got == want


def test_operator_rows(docs, rows, empty):  # noqa: F811
    want = brute([(r[2], r[1]) for r in rows], 5, 2000)
    assert found(phrases.collocations(docs, 5, 2000, 500)) == want
    assert phrases.collocations(empty).count() == 0


def test_a_very_long_text(spark):
    text = "one two three, " * 120_000
    df = spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string")
    got = found(phrases.collocations(df))
    assert got == [("en", 1, "one two three", 120_000, 120_000, 120_000, 360_000, 1_000_000, 0, 0)]


def test_intervals_count_phrases():
    r = np.random.default_rng(3)
    ids = np.concatenate([[0], r.integers(0, 7, 3000)]).astype(np.int32)
    ids[ids == 1] = 0
    forward = phrases.Index(phrases.transform(ids))
    before_, after_ = phrases.Breaks(forward.bwt == 0), phrases.Breaks(phrases.transform(ids[::-1]) == 0)
    sizes = np.bincount(ids, minlength=7)
    words = np.array([2, 3, 4, 5, 6])
    start = (np.cumsum(sizes) - sizes)[words]
    state, size, back, spelt = start, sizes[words], start, [(int(w),) for w in words]
    for _ in range(3):
        which, word, state, size, back = phrases.extend(forward, state, size, back)
        spelt = [(int(w), *spelt[p]) for p, w in zip(which, word)]
        k = len(spelt[0])
        want = Counter(tuple(map(int, ids[i : i + k])) for i in range(len(ids) - k + 1))
        want = {g: n for g, n in want.items() if min(g) > 1}
        assert dict(zip(spelt, map(int, size))) == want
        before, after = Counter(), Counter()
        ring = np.concatenate([ids, ids[:k]])
        for i in range(len(ids)):
            g = tuple(map(int, ring[i : i + k]))
            before[g] += ids[i - 1] > 1
            after[g] += ring[i + k] > 1 if i + k < len(ring) else 0
        assert dict(zip(spelt, map(int, before_.unbroken(state, size)))) == {g: before[g] for g in want}
        assert dict(zip(spelt, map(int, after_.unbroken(back, size)))) == {g: after[g] for g in want}


def test_scores_are_exact(spark):
    """Products past 64 bits."""
    values = [(2**62 // 3, 2**61, 2**61 + 5), (9_007_199_254_740_993, 9_007_199_254_740_999, 9_007_199_254_741_001), (30, 31, 33)]
    df = spark.createDataFrame(values, "n long, x long, y long").select("n", "x", "y", phrases._cuts([(F.col("x"), F.col("y")), (F.col("y"), F.col("y"))]).alias("s")).select("n", "x", "y", "s.*")
    for r in df.collect():
        assert (r["score"], r["cut"]) == min((2_000_000 * r["n"] // (r["x"] + r["y"]), 1), (2_000_000 * r["n"] // (2 * r["y"]), 2))


def test_reports_are_packed(spark, texts, monkeypatch):
    """What the shards hand on are rows by shard and block, not by phrase."""
    df = spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(3)
    made = []
    extend = type(df).mapInArrow

    def watched(self, *args, **kwargs):
        made.append(extend(self, *args, **kwargs))
        return made[-1]

    monkeypatch.setattr(phrases, "discard", lambda *tables: None)
    monkeypatch.setattr(type(df), "mapInArrow", watched)
    shards = phrases.index(df, 300)
    found = phrases.grams(shards, 2)
    monkeypatch.undo()
    at_most = shards.count() * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows, frequent in zip(made[1:], found[1:], strict=True):
        assert 0 < rows.count() <= at_most < frequent.count()
