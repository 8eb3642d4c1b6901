"""Cross-tokenizer alignment against brute force over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from scorebook.llm import alignment, queries
from tests.llm.test_operators import DOCS, docs, empty, rows  # noqa: F401


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, ranks, _, b_path = queries.aligned_vocabularies()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    return a, b, alignment.a_tokens(ranks), alignment.b_tokens(b)


def groups_of(text, tools):
    """[(a ids, b ids)] between shared ends of the whole text's tokens, or None."""
    a, b, a_bytes, b_bytes = tools
    if not text:
        return None
    ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
    spelt = [[table[i] for i in own] for table, own in zip((a_bytes, b_bytes), ids)]
    if any(b"".join(s) != (" " + text).encode() for s in spelt):
        return None
    ends = []
    for s in spelt:
        at, own = 0, []
        for t in s:
            at += len(t)
            own.append(at)
        ends.append(own)
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((ids[0][i:i2], ids[1][j:j2]))
        i, j = i2, j2
    return out


def brute(texts: list, tools) -> list[tuple]:
    found = [groups_of(t, tools) for t in texts]
    links = Counter((a[-1], b[-1]) for g in found if g for a, b in g)
    top: dict = {}
    for (_, b), n in links.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for g in found:
        if not g:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        counts = [(links[a[-1], b[-1]], b[-1]) for a, b in g]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(n == top[b] for n, b in counts), sum(n for n, _ in counts), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("chunk", "fan"), [(alignment.CHUNK_LINKS, alignment.FAN), (50, 2)])
def test_align(docs, rows, empty, tools, chunk, fan):  # noqa: F811
    """With small chunks and a small fan the runs are merged in several rounds."""
    got = alignment.align(docs, queries.aligned_vocabularies(), chunk, fan).toPandas()
    want = brute([r[1] for r in rows], tools)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got[COLUMNS].itertuples(index=False)), key=key) == sorted(want, key=key)
    by_id = {r[0]: w for r, w in zip(rows, want)}
    assert all(tuple(x[1:]) == by_id[None if x[0] != x[0] else x[0]] for x in got[["doc_id", *COLUMNS]].itertuples(index=False))
    assert alignment.align(empty, queries.aligned_vocabularies(), chunk, fan).count() == 0


def test_pairs(docs, rows, tools):  # noqa: F811
    found = [groups_of(r[1], tools) for r in rows]
    links = Counter((a[-1], b[-1]) for g in found if g for a, b in g)
    got = alignment.pairs(docs, queries.aligned_vocabularies(), 200, 3).collect()
    assert {(r["a_id"], r["b_id"]): r["links"] for r in got} == dict(links)
    for r in got:
        assert r["best"] == (r["links"] == max(n for (_, b), n in links.items() if b == r["b_id"]))


def test_pieces_of_odd_texts(tools):
    """Random strings with all white space, marks, controls and several scripts, against whole texts."""
    aligner = alignment.Aligner(*queries.aligned_vocabularies())
    r = random.Random(5)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    pool = [*"abXY01'.!-", *" " * 12, *spaces, *map(chr, range(32)), "▁", "é", "中", "ع", "🙂", "́", "don't", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "  ", "﻿", "ﬁ"]
    for _ in range(20_000):
        text = "".join(r.choices(pool, k=r.randint(0, 16)))
        found, want = aligner.align(text), groups_of(text, tools)
        if want is None:
            assert found is None, repr(text)
        else:
            assert found is not None and found[3] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want), repr(text)


def test_long_text_without_spaces():
    aligner = alignment.Aligner(*queries.aligned_vocabularies())
    n_a, n_b, n_groups, _, keys = aligner.align("中文字" * 50_000)
    assert n_groups == len(keys) // 4 and min(n_a, n_b) >= n_groups > 0


def test_possible_pairs(tools):
    _, _, a, b = tools
    assert alignment.possible_pairs(list(a.values()), b) < 300_000
    assert alignment.possible_pairs([b"a", b"ba"], [b"a", b"cba"]) == 4
