"""Best-fit packing against brute force."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from scorebook.llm import best_fit, queries
from tests.llm.test_operators import DOCS, docs, empty, rows  # noqa: F401


def fullest(counts: dict, window: int) -> int:
    """The largest sum around the longest piece, by trying all."""
    longest = max(n for n, c in counts.items() if c)
    left = {n: c - (n == longest) for n, c in counts.items()}
    best = 0
    for ks in itertools.product(*[range(min(c, window // n) + 1) for n, c in left.items()]):
        total = longest + sum(n * k for n, k in zip(left, ks))
        best = max(best, total if total <= window else 0)
    return best


def test_each_combination_is_the_fullest():
    r = random.Random(2)
    for _ in range(60):
        window = r.randint(8, 40)
        counts = {n: r.randint(0, 4) for n in r.sample(range(1, window + 1), min(window, 5))}
        slack = best_fit.Slack(counts, window)
        while slack.lengths:
            now = dict(slack.counts)
            use = slack.fullest()
            assert slack.counts == now and all(k <= now[n] for n, k in use.items())
            assert sum(n * k for n, k in use.items()) == fullest(now, window)
            times = slack.take(use)
            assert times >= 1 and all(slack.counts[n] == now[n] - times * use.get(n, 0) for n in now)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    window = 2048
    counts = {n: r.randint(1, 10 ** r.randint(0, 5)) for n in r.sample(range(1, window + 1), 300)}
    entries = best_fit.plan(counts, window)
    by_length: dict = {}
    for n, first, copies, sequence, offset in entries:
        assert by_length.get(n, 0) == first
        following = [e[1] for e in entries if e[0] == n and e[1] > first]
        by_length[n] = min(following, default=counts[n])
        assert (by_length[n] - first) % copies == 0
    assert by_length == counts


@pytest.mark.parametrize("seed", range(6))
def test_plan_needs_no_more_than_best_fit_decreasing_and_one(seed):
    r = random.Random(seed)
    window = 256
    counts = {n: r.randint(1, 12) for n in r.sample(range(1, window + 1), r.choice([20, 100, 200]))}
    sequences = 0
    slack = best_fit.Slack(counts, window)
    while slack.lengths:
        sequences += slack.take(slack.fullest())
    rooms: list[int] = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(window - n)
    assert -(-sum(n * c for n, c in counts.items()) // window) <= sequences <= len(rooms) + 1


def test_pack(spark, docs, rows, empty):  # noqa: F811
    from tokenizers import Tokenizer

    path = queries.tokenizer_json()
    whole = (path, *queries.tiktoken_vocabulary())
    tokenizer = Tokenizer.from_file(path)
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows if i is not None}
    for window in (64, 2048):
        got = best_fit.pack(some, *whole, window).toPandas()
        assert set(got["doc_id"]) == set(ids)
        for doc, own in got.groupby("doc_id"):
            own = own.sort_values("piece")
            assert list(own["piece"]) == list(range(len(own)))
            at = 0
            for p in own.itertuples():
                assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids[doc]) and all(own["length"].iloc[1:] == window) and own["length"].iloc[0] <= window
        full = 0
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert list(s["offset"]) == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= window
            full += 1
        assert full <= -(-got["length"].sum() // window) * 1.05 + 1
    assert best_fit.pack(empty, *whole).count() == 0
    assert best_fit.pack(docs, *whole).where("doc_id is null").count() == 1 and best_fit.pack(docs, *whole).count() >= len(rows)
