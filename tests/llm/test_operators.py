"""The training-data operators against brute force, on small tables with nulls, ties, empty and odd texts."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorebook.llm import common, components, hilbert, langid, lm, mixing, ngram_join, packing, quality, queries, secrets, spotsigs, warc

WORDS = "the of and to in tree stone river cloud der die und haus le la et maison que rouge el los y casa".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, component string, part int, row long"


def crc(i) -> int:
    return zlib.crc32(b"" if i is None else str(i).encode())


@pytest.fixture(scope="module")
def rows():
    """Documents with near copies, copies, nulls, repeats, ties and a long text."""
    r = random.Random(7)
    texts = [" ".join(r.choices(WORDS, k=r.randint(12, 90))) + r.choice([".", "\n", ""]) for _ in range(60)]
    for i in range(15):
        w = texts[i].split()
        w[len(w) // 2] = f"new{i}"
        texts.append(" ".join(w))
        texts.append(texts[i])
        texts.append(" ".join(w[: int(len(w) * 0.8)]))
    texts += ["", None, "   \n\t ", "one", "one two three", "ONE two three", "a  b   c", "é ß", "\n".join(["same line here now"] * 30), "x" * 5000, " ".join(r.choices(WORDS, k=4000))]
    out = [(i * 3, t, r.choice(["en", "de", None]), r.choice(["s0", "s1", None]), None, "k", 1, "c", 2, 5) for i, t in enumerate(texts)]
    return [*out, out[0], (None, "text without an id " * 4, "en", "s0", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- WARC


def test_warc(spark):
    big = "<html>" + "é" * 100
    pages = [(5, "http://A.Example.com/x?q=1#f", big), (3, "https://b.org", big), (9, None, big), (4, "no url", "small"), (6, "http://a.example.com/x?q=1", "small"), (7, "http://c.d/\r\nX: y", None), (8, "http://c.d/", "a\r\n\r\nWARC/1.1\r\n\r\n" * 9), (5, "http://A.Example.com/x?q=1#f", big)]
    got = warc.capture_histories(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages) and sorted(r["history_pos"] for r in got) == list(range(len(pages)))
    for r in got:
        html = next(h for p, _, h in pages if p == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if html == big and r["page_id"] != 3 else ("response", None))
    keys = [(r["url_key"].encode(), r["time"], r["page_id"]) for r in sorted(got, key=lambda r: r["history_pos"])]
    assert keys == sorted(keys) and warc.url_key("http://A.Example.com/x?q=1#f") == "com,example,a)/x?q=1"
    assert warc.capture_histories(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_files_are_archives(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([(1, "http://a/", "abc")], "page_id long, url string, html string"), path)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\nabc\r\n\r\n")
    assert [b for _, b in warc.records(io.BytesIO(data))] == [b"abc"]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted((("r", 0, r.choice("abc"), str(r.randint(0, 9)), r.randint(0, 99)) for _ in range(r.randint(0, 20))), key=warc._order) for _ in range(k)]
    assert [warc._order(x) for x in warc.LoserTree(runs)] == sorted(warc._order(x) for run in runs for x in run)


# --- language model


def test_lm(docs, rows, empty):
    train = Counter()
    for i, t, *_ in rows:
        if crc(i) % 7 != 2:
            train.update(words(low(t)))
            train[""] += 1
    n, v = sum(train.values()), len(train)
    for options in ({}, {"head": 20, "bigram_words": 12, "trigram_words": 6, "max_grams": 60}, {"head": 0}):
        got = lm.score(docs, **options).collect()
        assert len(got) == len(rows)
        texts = {i: t for i, t, *_ in rows}
        for r in got:
            tokens = [*words(low(texts[r["doc_id"]])), ""]
            assert r["held_out"] == (crc(r["doc_id"]) % 7 == 2) and r["n_tokens"] == len(tokens) and r["train_tokens"] == n
            assert r["n_known"] == sum(train[w] > 0 for w in tokens)
            assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens))
            if options.get("head") == 0:
                assert r["score"] == pytest.approx(r["base_score"])
    assert lm.score(empty).count() == 0


def test_lm_states_are_distributions(docs):
    """Over the whole vocabulary and one unknown word, each state's probabilities sum to 1."""
    texts = [low(r["text"]).encode() for r in docs.collect()]
    counts = Counter(w for t in texts for w in [*t.split(), b""])
    order = sorted(counts, key=lambda w: (-counts[w], w))
    head = lm.Head(order, np.array([counts[w] for w in order]), sum(counts.values()), len(counts), len(texts))
    bi, tri = 15, 8
    grams = Counter()
    for t in texts:
        ids = [bi, *(i if i < bi else -1 for i in map(order.index, t.split())), order.index(b"")]
        ids = [i if i < bi or i == bi and at == 0 else -1 for at, i in enumerate(ids)]
        for x, y in zip(ids, ids[1:]):
            if x >= 0 and 0 <= y < bi:
                grams[x << lm._BITS | y] += 1
        for x, y, z in zip(ids, ids[1:], ids[2:]):
            if min(x, y, z) >= 0 and y < bi and z < bi and y < tri:
                grams[lm._TRI | x << 2 * lm._BITS | y << lm._BITS | z] += 1
    kept = {g: c for g, c in grams.items() if c > 1}
    a = lm.Automaton(head, np.array(sorted(kept)), np.array([kept[g] for g in sorted(kept)]), bi)
    log10 = head.log10.tolist()

    def p(state: int, w: int) -> float:
        total = 0.0
        while (arc := a.arcs.get(state << lm._BITS | w)) is None and state:
            total += a.back[state]
            state = a.fail[state]
        return 10 ** (total + (arc[0] if arc else log10[w]))

    assert len(a.fail) > 10
    for state in range(len(a.fail)):
        unseen = 10 ** (a.all_back[state] + head.unseen)
        assert sum(p(state, w) if w < bi else 10 ** (a.all_back[state] + log10[w]) for w in range(len(order))) + unseen == pytest.approx(1)


@pytest.mark.parametrize(("hot", "chunk"), [(lm.HOT, lm.CHUNK_TOKENS), (40, 100), (0, 1)])
def test_lm_counts_all_words(spark, hot, chunk):
    """Pairs and triples of rare words too: the scores are those of a backoff model over every n-gram."""
    r = random.Random(9)
    texts = [" ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1500, 3000))]
    texts += [" ".join(f"w{r.randint(0, 40)}" for _ in range(r.randint(0, 60))) for _ in range(40)] + ["w2900 w2901 w2902 unknown w2903", "", None]
    got = {x["doc_id"]: x for x in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), hot=hot, chunk_tokens=chunk).collect()}
    runs = {i: ["<", *words(t), ""] for i, t in enumerate(texts)}
    grams = [Counter(), Counter(), Counter()]
    for i, t in runs.items():
        if crc(i) % 7 != 2:
            for n in range(3):
                grams[n].update(tuple(t[k : k + n + 1]) for k in range(len(t) - n))
    start = grams[0].pop(("<",))
    z = sum(grams[0].values()) + len(grams[0]) + 1
    total = lambda c: start if c == ("<",) else grams[len(c) - 1][c]
    after: dict = {}
    for g, c in [*grams[1].items(), *grams[2].items()]:
        if c > 1:
            after.setdefault(g[:-1], {})[g[-1]] = c

    def p(c: tuple, w: str) -> float:
        if not c:
            return (grams[0][w,] + 1) / z
        arcs = after.get(c, {})
        if w in arcs:
            return (arcs[w] - lm.DISCOUNT) / total(c)
        if not arcs:
            return p(c[1:], w)
        return p(c[1:], w) * back(c)

    seen: dict = {}

    def back(c: tuple) -> float:
        if c not in seen:
            seen[c] = (1 - sum(n - lm.DISCOUNT for n in after[c].values()) / total(c)) / (1 - sum(p(c[1:], w) for w in after[c]))
        return seen[c]

    assert len(got) == len(texts) and ("w2900", "w2901") in {(*c, w) for c, a in after.items() for w in a}
    for i, t in runs.items():
        assert got[i]["score"] == pytest.approx(sum(math.log10(p(tuple(t[max(0, k - 2) : k]), t[k])) for k in range(1, len(t)))), i
        assert got[i]["base_score"] == pytest.approx(sum(math.log10(p((), w)) for w in t[1:]))


# --- secrets


def test_secrets(spark, docs, empty):
    path, pattern = queries.tiktoken_vocabulary()
    token = "q7Zp2Xv9Lk4Rt8Wm3Nc6Yb1D"
    texts = ["", None, 'password = "hunter22" é API_KEY:abc', f"AKIA{'A1' * 9} {'ab12' * 6} secret:  x.y-z==", f"see {token} and d41d8cd98f00b204e9800998ecf8427e", "token=short1 Token: longer_one", "ſecret=abcdefg", "passwd=" + "a" * 9000, "123e4567-e89b-12d3-a456-426614174000"]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, pattern).collect()}
    for i, t in enumerate(texts):
        t, spans = t or "", []
        for k, (p, least, flags) in enumerate([(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, re.I | re.A), ("(AKIA)([A-Z0-9]+)", 16, 0), ("()([0-9a-f]+)", 24, 0)]):
            spans += [(m.start(), k, m.end()) for m in re.finditer(p, t, flags) if len(m[2]) >= least]
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert f"random:4:{4 + len(token)}" in got[4]["spans"].split(",") and got[8]["n_random"] == 0
    clean = secrets.redact(spark.createDataFrame([(4, texts[4], 1), (5, None, 2)], "doc_id long, text string, extra int"), path, pattern).orderBy("doc_id").collect()
    assert clean[0]["text"] == "see [SECRET] and [SECRET]" and clean[0]["extra"] == 1 and clean[1]["text"] is None
    assert secrets.scan(empty, path, pattern).count() == 0 and secrets.scan(docs, path, pattern).count() == docs.count()


def test_secrets_of_letters_only():
    encoding = common.tiktoken_encoding(*queries.tiktoken_vocabulary())
    token = "xkdqLqPzzvWmwRtYbrNcHjQzTgBn"
    assert secrets.random_spans(f"see {token} here", encoding) == [(4, 3, 4 + len(token))]
    for plain in ("internationalization", "Donaudampfschifffahrtsgesellschaft", "state-of-the-art-methods", "snake_case_names_here", "UNCHARACTERISTICALLY"):
        assert secrets.random_spans(f"see {plain} here", encoding) == []


# --- mixing


def test_mixing(spark, docs, empty):
    r = random.Random(3)
    data = []
    for i in range(300):
        toxic, junk = i % 6 == 0, i % 5 == 0
        data.append((i, " ".join(r.choices(WORDS, k=40) + ["vile"] * 2 * toxic) + " #&*" * 30 * junk))
    some = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 6 == 0)) for i in range(0, 300, 2)] + [(None, 1, 0), (1, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = mixing.rates(some, labels).toPandas()
    names = [mixing._name(d) for d in mixing.TARGETS]
    assert len(got) == 300 and (got["rate"] >= 0).all() and got[names].sum(axis=1).between(1 - 1e-9, 1 + 1e-9).all()
    tokens = got["n_tokens"].to_numpy()[:, None] * got[names].to_numpy()
    have, want = got["rate"].to_numpy() @ tokens, tokens.sum() * np.array(list(mixing.TARGETS.values()))
    # Brute force: projected gradient in numpy.
    w, t = np.ones(300), tokens.sum(0)
    for _ in range(mixing.STEPS):
        off = w @ tokens - want
        if abs(off).max() <= mixing.CLOSE * max(1, t.sum()):
            break
        w = np.maximum(0, w - got[names].to_numpy() @ (off / t))
    assert np.allclose(w, got["rate"], atol=1e-6) and abs(have - want).max() < 0.01 * tokens.sum()
    predicted = got.set_index("doc_id")[names[2]] + got.set_index("doc_id")[names[3]] > 0.5
    assert sum(bool(predicted[i]) == (i % 6 == 0) for i in range(300)) > 290
    kept = {x["doc_id"] for x in mixing.mix(some, labels).collect()}
    assert all(i % 6 for i in kept) and {i for i in range(300) if i % 6 and i % 5} <= kept
    # Labels without a document and copies of a text tell nothing; input columns keep their names and values.
    more = labels.union(spark.createDataFrame([(i, 0, 1) for i in range(1000, 1400)], labels.schema))
    assert mixing.classifier(some.union(some), more)[1] == mixing.classifier(some, labels)[1]
    clash = some.withColumns({c: F.lit(7) for c in ("_id", "_hash", "_copies", "_copy", "n_tokens", "row")})
    assert {(x["doc_id"], x["_copy"], x["_id"]) for x in mixing.mix(clash, labels).collect()} == {(i, 7, 7) for i in kept}
    none = labels.where("false")
    assert mixing.rates(docs, none).count() == docs.count() and mixing.rates(empty, labels).count() == 0


@pytest.mark.parametrize("junk_share", [0.05, 0.3, 0.6])
def test_mix_meets_targets(spark, junk_share):
    """Realised token shares of the clean domains, whatever their shares are before."""
    r = random.Random(12)
    data = []
    for i in range(3000):
        toxic, junk = i % 20 == 0, r.random() < junk_share
        text = " ".join(r.choices(WORDS, k=40) + ["vile"] * 2 * toxic) + " #&*" * 30 * junk
        data.append((i if i % 50 else None, f"{text} n{i}", int(not junk), int(toxic)))
    some = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in data], "doc_id long, quality int, toxic int")
    tokens: Counter = Counter()
    of = {t: (q, x) for _, t, q, x in data}
    for x in mixing.mix(some, labels).collect():
        tokens[of[x["text"]]] += len(x["text"].split())
    assert tokens[0, 1] == tokens[1, 1] == 0
    assert tokens[0, 0] / sum(tokens.values()) == pytest.approx(0.08 / 0.98, abs=0.02)


# --- quality


def test_quality_counts(docs, rows, empty):
    got = quality.assess(docs, carry=True).collect()
    assert len(got) == len(rows)
    for r in got:
        t, w = r["_doc"]["text"] or "", words(r["_doc"]["text"])
        at: dict = {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        twice = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["q_words"], r["q_word_chars"], r["q_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r["q_dup_lines"], r["q_repeats"]) == (len(lines) - len(set(lines)), len(twice))
        assert r["q_base_failed"] == (len(w) < 10 or 100 * len(twice) > 20 * len(w)) and not (r["q_base_failed"] and r["q_kept"])
    assert quality.assess(empty).count() == 0 and quality.keep_good(docs.withColumn("g", F.lit(1))).columns == [*docs.columns, "g"]


def test_quality_outliers(spark):
    """Rows far from a group's scatter go, the rest stay; the estimate is near numpy's over the clean rows."""
    r = np.random.default_rng(1)
    x = r.normal(0, [0.2, 0.9, 0.3, 0.3], (1200, 4)) @ np.array([[1, 0.3, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0.2], [0, 0, 0, 1]])
    x[:120] += [8, 20, 5, 5]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=quality.FEATURES).assign(g="a"))
    model = quality.fit(rows).first()
    assert np.allclose([model[f"m_{i}"] for i in range(4)], x[120:].mean(0), atol=0.1)
    lower = np.array([[model[f"l_{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    true = np.cov(x[120:].T) + np.diag([f**2 for f in quality.FLOORS.values()])
    assert np.allclose(lower @ lower.T, true, rtol=0.35, atol=0.05)
    assert quality.chi_square(quality.chi_square_cut(0.75, 4), 4) == pytest.approx(0.75) and quality.chi_square_cut(0.95, 2) == pytest.approx(5.991, abs=1e-3)


def test_quality_least_determinant(spark):
    """Of the starts the one with the least determinant counts, and more steps do not lower it."""
    r = np.random.default_rng(3)
    scale = np.array([0.3, 0.8, 0.3, 0.3])
    groups = {"a": np.r_[r.normal(0, scale, (700, 4)), r.normal(4, 3 * scale, (200, 4))], "b": r.normal(1, scale, (300, 4))}
    rows = spark.createDataFrame(pd.concat(pd.DataFrame(x, columns=quality.FEATURES).assign(g=g) for g, x in groups.items()))
    got = {m["g"]: m for m in quality.fit(rows).collect()}
    floor = np.diag([f**2 for f in quality.FLOORS.values()])
    cut = quality.chi_square_cut(0.75, 4)
    factor = 0.75 / quality.chi_square(cut, 6)
    for g, x in groups.items():
        least = np.inf
        for start in range(40):  # brute force: concentration from random starts
            own = x[r.choice(len(x), 20, replace=False)]
            for _ in range(30):
                m, c = own.mean(0), np.cov(own.T, bias=True) * factor + floor
                far = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
                own = x[np.argsort(far)[: int(0.75 * len(x))]]
            least = min(least, np.linalg.slogdet(np.cov(own.T, bias=True) * factor + floor)[1])
        assert got[g]["logdet"] == pytest.approx(least, abs=0.05)


def test_quality_pools(spark):
    sizes = {("en", "a"): 250, ("en", "b"): 120, ("en", "c"): 90, ("de", "a"): 150, (None, None): 60, ("fr", "a"): 5}
    data = [(la, so) for (la, so), n in sizes.items() for _ in range(n)]
    got = {(r["lang"], r["source"]): r["g"] for r in quality.grouped(spark.createDataFrame(data, "lang string, source string")).distinct().collect()}
    assert got[("en", "b")] == got[("en", "c")] != got[("en", "a")] and got[("de", "a")] == got[(None, None)] == got[("fr", "a")] == "rest"


@pytest.mark.parametrize("clean", [100, 300])
def test_quality_planted_outliers(spark, clean):
    """Each statistic rejects by itself, in a small table too, and clean texts stay."""
    r = random.Random(11)
    fresh = lambda n, size=5: ["".join(r.choices("abcdefgh", k=size + r.randint(-1, 1))) for _ in range(n)]
    data = [" ".join(fresh(r.randint(60, 200))) for _ in range(clean)]
    again = fresh(75)
    data += [
        "\n".join(x for _ in range(60) for x in (" ".join(fresh(6)), "ok")),
        " ".join([*fresh(400), *again, *fresh(400), *again]),
        " ".join(fresh(150)) + " #" * 30,
        " ".join(fresh(300, 11)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(data)], "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in quality.assess(docs).collect()}
    assert not any(x["q_base_failed"] for x in got.values())
    assert [i for i in range(clean, clean + 4) if got[i]["q_kept"]] == []
    assert sum(got[i]["q_kept"] for i in range(clean)) >= 0.99 * clean


# --- n-gram join


def shingle_set(text) -> frozenset:
    w = words(low(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def closure(ids, links) -> dict:
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(sets: dict) -> list:
    return [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("small", [False, True])
def test_join(docs, rows, empty, small):
    """With ``small``, columns are dealt to parts, lists to segments, nodes to slices of a few, and pairs to tiles of a few."""
    bounds = ngram_join.Bounds(chunk_entries=500, hot=2, parts=3, segment=2, slice_entries=100, tile=7, lists=3) if small else ngram_join.Bounds()
    sets = {i: shingle_set(t) for i, t, *_ in rows if i is not None}
    want = closure(sets, near(sets))
    got = ngram_join.join(docs, bounds=bounds).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i in sets if want[i] == i)
    assert ngram_join.join(empty).count() == 0


def test_join_chains_and_passages(spark):
    """A long chain of links, a large group around one text, and a passage that unrelated texts share."""
    r = random.Random(5)
    fresh = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    texts, w = [], fresh(100)
    for _ in range(25):
        w = [*w[8:], *fresh(8)]
        texts.append(" ".join(w))
    core = fresh(120)
    for _ in range(60):
        v = list(core)
        v[r.randrange(120)] = fresh(1)[0]
        texts.append(" ".join(v))
    passage = fresh(50)
    texts += [" ".join(fresh(r.randint(10, 60)) + passage + fresh(r.randint(5, 90))) for _ in range(60)]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    want = closure(sets, near(sets))
    assert {x["doc_id"]: x["component_id"] for x in ngram_join.join(df).collect()} == want and len(set(want.values())) < 70


def test_join_copies_over_many_tasks_do_not_meet(spark, monkeypatch):
    """Copies that several tasks read are one node in the lists, and still one component."""
    r = random.Random(6)
    texts = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(r.choice([2, 5, 40]))) for _ in range(20)]
    df = spark.createDataFrame([(i * 100 + j, t) for i in range(6) for j, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    met, incidence = [], ngram_join._incidence
    monkeypatch.setattr(ngram_join, "_incidence", lambda lists, *a: met.append(lists.count()) or incidence(lists, *a))
    assert all(x["component_id"] == x["doc_id"] % 100 for x in ngram_join.join(df).collect()) and met == [0]


def test_join_messages_are_in_proportion():
    """Chunks times blocks, the most messages there can be, over the bytes; the largest chunk stays a few times the least."""
    found = [(size / b.chunk_entries) * (size / b.block_bytes) / size for size in (1 << 30, 6 << 30, 15 << 30) for b in [ngram_join._grown(ngram_join.Bounds(), size)]]
    assert max(found) < 1.01 * min(found)
    assert ngram_join._grown(ngram_join.Bounds(), 1 << 50).chunk_entries == 4 * ngram_join.Bounds().chunk_entries


def test_join_names_words_by_all_their_bytes():
    r = random.Random(7)
    words = [bytes(r.choice(b"abcXYZ\xc3\xa9,.") for _ in range(r.choice([1, 2, 64, 65, 90]))) for _ in range(300)]
    words += [words[0] + b"a" * 70 + x for x in (b"a", b"b")]
    space = [b" ", b"\n", b"\x0b", b"  ", b"\x1c ", b"\t\r"]
    texts = [b"".join(x for _ in range(n) for x in (r.choice(words[: r.choice([3, 302])]), r.choice(space))) for n in [0, 1, 3, 4, 5, 6, 50, 3000] * 20] + [b"", b" ", b"\n\n"]
    got = list(ngram_join._sets(iter(texts)))
    for text, s in zip(texts, got, strict=True):
        w = text.lower().split()
        assert len(s) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} - {()}) and np.array_equal(s, ngram_join.shingles(text))


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {i for p in links if p[0] != p[1] for i in p}
    assert {i: got[i] for i in ids} == {i: c for i, c in closure({j for p in links for j in p}, links).items() if i in ids}


# --- SpotSigs


def chains(text) -> set:
    w, out = words((text or "").lower()), set()
    stop = set(spotsigs.ANCHORS)
    for i, x in enumerate(w):
        if x in stop:
            found = [y for y in w[i + 1 :] if y not in stop][:2]
            if len(found) == 2:
                out.add((x, *found))
    return out or {("", text or "")}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def test_spotsigs(docs, rows, empty):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {i: t or "" for i, t, *_ in rows if i is not None}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in spotsigs.compare_edited(some).collect()}
    assert set(got) == set(order)
    for i, following in zip(order, order[1:] + order[:1]):
        t, n = texts[i], texts[following]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(jaccard(chains(t), chains(edited))) and got[i]["near_next"] == pytest.approx(jaccard(chains(t), chains(n)))
    prints: dict = {}
    for i, t in texts.items():
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert spotsigs.compare_edited(docs).count() == len(rows) and spotsigs.compare_edited(empty).count() == 0
    assert spotsigs.compare_edited(some.where("doc_id = 0")).first()["near_next"] == 1.0
    first: dict = {}
    for i, t in texts.items():
        first.setdefault(frozenset(chains(t)), i)
    want = {tuple(sorted((first[a], first[b]))) for a, b in itertools.combinations(first, 2) if jaccard(set(a), set(b)) >= 0.75}
    assert {tuple(sorted((r["a"], r["b"]))) for r in spotsigs.near_duplicates(some).collect()} == want


def test_spotsigs_of_long_runs(spark):
    """Any gaps between words, and texts of common words alone, which take time in step with their length."""
    rnd = random.Random(9)
    words_ = ["the", "The", "of", "zu", "que", "x", "dog", "theme", "é"]
    texts = ["".join(rnd.choice(words_) + rnd.choice([" ", "  ", "\n", "\t ", "\x0b", " \r\n"]) for _ in range(rnd.randrange(30))) for _ in range(300)]
    signs = spotsigs.signatures(F.col("t"))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.size(signs).alias("n"))
    assert {r["i"]: r["n"] for r in got.collect()} == {i: len(chains(t)) for i, t in enumerate(texts)}
    began = time.time()
    runs = spark.createDataFrame([("the " * 20_000,), (" of the" * 20_000 + " cat dog is x z",), ("the dog " * 20_000,)], "t string").select(F.size(signs).alias("n"))
    assert [r["n"] for r in runs.collect()] == [1, 3, 1] and time.time() - began < 5


# --- packing


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_json()
    tokenizer = Tokenizer.from_file(path)
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows if i is not None}
    for window in (64, 2048):
        got = packing.pack(some, path, *queries.tiktoken_vocabulary(), window).toPandas()
        for doc, own in got.groupby("doc_id"):
            at = 0
            for p in own.sort_values("start").itertuples():
                assert p.start == at and p.doc_tokens == len(ids[doc])
                assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids[doc])
        assert set(got["doc_id"]) == set(ids)
        short = 0
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert list(s["offset"]) == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= window
            short += s["length"].sum() < window
        assert short <= some.rdd.getNumPartitions()
    whole = (path, *queries.tiktoken_vocabulary())
    assert packing.pack(empty, *whole).count() == 0 and packing.pack(docs, *whole).count() >= len(rows)


def test_encoding_by_chunks():
    from tokenizers import Tokenizer

    path = queries.tokenizer_json()
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(4)
    texts = ["".join(r.choices([" ", "  ", "\n", "\t", " ", "a", "it's", "É", "12", "!?", "<|endoftext|>", "word", "　"], k=r.randint(0, 30))) for _ in range(3000)]
    for text, made in zip(texts, packing.encode(texts, path, *queries.tiktoken_vocabulary())):
        assert np.frombuffer(made, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoding_of_every_space():
    """All code points beside letters, digits and spaces, and random strings of all white space."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_json()
    tokenizer = Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    r = random.Random(9)
    pool = [*"abXY01'.!-<|>", *" " * 12, *[c for c in points if c.isspace()], *map(chr, range(32)), "\u200b", "\u200d", "\ufeff", "\u180e", "é", "中", "ع", "ด", "🙂", "\u0301", "'s", "  "]
    texts = ["a \xa0 \xa0 b", *(f"a{c}b 1{c}2 {c} x{c}" for c in points[:0x3100]), *("".join(r.choices(pool, k=r.randint(0, 14))) for _ in range(60_000))]
    made = packing.encode(texts, path, *queries.tiktoken_vocabulary())
    for text, one, whole in zip(texts, made, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(one, "<u4").tolist() == whole.ids, repr(text)


def test_level_array_minimises_squares():
    r, levels, window = random.Random(1), packing.LevelArray(32), 32
    for _ in range(400):
        size = r.randint(1, 31)
        before = levels.counts.copy()
        best = None
        for h in range(window - size + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= h > 0
            after[h + size] += h + size < window
            best = min(best, int((after[1:window] ** 2).sum())) if best is not None else int((after[1:window] ** 2).sum())
        levels.place((size, 0, 0, b"\0" * 4 * size, size))
        assert int((levels.counts[1:window] ** 2).sum()) == best


# --- sharding


def test_hilbert_curve():
    for bits in (1, 2, 3):
        n = 1 << bits
        points = np.array(list(itertools.product(range(n), repeat=3)))
        at = hilbert.curve_index(list(points.T), bits)
        assert sorted(at) == list(range(n**3))
        walk = points[np.argsort(at)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shards(docs, rows, empty):
    got = hilbert.shard(docs).toPandas()
    assert len(got) == len(rows)
    counts = got.groupby("shard").size()
    assert len(counts) == 16 and counts.max() - counts.min() <= 1
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    texts = {i: t or "" for i, t, *_ in rows}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        t = texts[int(r.doc_id)]
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
    assert hilbert.shard(empty).count() == 0


# --- language identification


def test_suffix_automaton():
    r = random.Random(6)
    for _ in range(60):
        text = "".join(r.choices("abc ", k=r.randint(1, 60)))
        automaton = langid.SuffixAutomaton(text)
        for _ in range(10):
            word = "".join(r.choices("abcd ", k=r.randint(0, 25)))
            n, at = 0, 0
            while at < len(word):
                size = 1
                while at + size < len(word) and word[at : at + size + 1] in text:
                    size += 1
                at += size if word[at] in text else 1
                n += 1
            assert automaton.phrases(word) == n


def test_languages(spark, empty):
    r = random.Random(8)
    syllables = {"en": ["th", "ing", "er", "ou"], "de": ["sch", "ung", "ei", "ß"], "fr": ["eau", "è", "ion", "qu"]}
    make = lambda la, n: " ".join("".join(r.choices(syllables[la], k=r.randint(1, 4))) for _ in range(n))
    data = [(i, make(la, r.randint(3, 80)), la if i % 9 else None) for i in range(400) for la in [r.choice(list(syllables))]]
    truth = {i: next(la for la, s in syllables.items() if any(x in t for x in s)) for i, t, _ in data}
    data += [(1000, None, "en"), (1001, "12 !", "en"), (1002, "", None), (None, make("en", 9), None)]
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(data) and all(got[i]["lang_pred"] == "und" for i in (1000, 1001, 1002))
    assert all(x["held_out"] == (crc(i) % 3 == 1) and 0 <= x["score"] <= 1 for i, x in got.items())
    held = [i for i in truth if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) > 0.95 * len(held)
    assert langid.identify(empty).count() == 0


def test_languages_fill_their_samples(spark):
    """Languages of long texts only, of many short ones, and more than 64 of them, are all learned from equally much."""
    r = random.Random(10)
    make = lambda la, n: " ".join("".join(r.choices([chr(0x4E00 + 3 * la + k) for k in range(3)], k=4)) for _ in range(n))
    data = [(i, make(0, 10_000), "l0") for i in range(5)] + [(100 + i, make(1, 10), "l1") for i in range(2000)]
    data += [(5000 + i, "12 ! " * 200 + make(2, 20), "l2") for i in range(800)] + [(9000 + 9 * la + k, make(la, 20), f"l{la}") for la in range(3, 80) for k in range(9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = langid.sample(docs, F.lit(False))
    assert len(got) == 80 and all(langid.SAMPLE_CHARS <= len(got[la]) <= langid.SAMPLE_CHARS + 10 for la in ("l0", "l1", "l2"))
    found = {x["doc_id"]: x["lang_pred"] for x in langid.identify(docs, chars=2000).collect()}
    assert all(found[i] == la for i, _, la in data)


# --- pipeline


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = common.materialise(stage(spark, now, str(tmp_path)), "stage")
        if k < 4:
            assert now.columns == docs.columns
        if k == 0:
            kept = {r["doc_id"] for r in now.collect()}
            assert all(len(words(t)) >= 10 for i, t, *_ in rows if i in kept)
        if k == 1:
            sets = {r["doc_id"]: shingle_set(r["text"]) for r in now.collect()}
            assert not [p for p in near({i: s for i, s in sets.items() if i is not None})]
    assert now.columns == [f.name for f in packing.SCHEMA]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length").collect()), key=str) == sorted(map(tuple, now.select("doc_id", "length").collect()), key=str)


def test_pipeline_of_nothing_and_of_further_columns(spark, tmp_path, rows):
    """No stage needs a row, and none trips over columns with the names of its own."""
    import corpus_pipeline

    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(r[0], 1, 0) for r in rows], labels).write.parquet(str(tmp_path / "labels.parquet"))
    own = "doc_id long, text string, lang string, source string, n_chars long"
    more = ["q_words", "kept", "n", "part", "component", "spans", "rate", "sequence_id", "start", "length", "_at", "rank", "value"]
    full = spark.createDataFrame([(*r[:5], *range(len(more))) for r in rows], own + "".join(f", {m} long" for m in more))
    for now in (full.limit(0), full):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns, empty_ = now.columns, now.isEmpty()
            now = common.materialise(stage(spark, now, str(tmp_path)), "stage")
            assert k == 4 or now.columns == columns
            assert now.isEmpty() == empty_
