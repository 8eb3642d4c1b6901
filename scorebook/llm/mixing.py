"""Mixing sources to target weights by soft membership, on DataFrame functions alone.

A labelled table gives two yes/no labels (quality, toxic), whose combinations are the domains. A naive Bayes
classifier over the presence or absence of hashed words, with counts shrunk toward independence and only words
that mark a label's rarer value significantly, gives each document a posterior of each domain. Nonnegative rates per document are then
fitted by projected gradient descent, so that the expected tokens of each domain, sum of rate * tokens *
posterior, match the targets in least squares; the descent starts at rate 1 and so stays close to it.

A step needs one number per domain from the whole table, the residual. The rate is a function of the
posteriors and of all residuals so far, so no rates are stored between steps.

Defined results: null or empty text has no tokens and the prior's posterior; repeated rows get a row each;
without labels, or with one label value only, the posteriors are the prior; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialise

#: The bound of the fit: labelled rows, those of smallest id hash; and cells for hashed words.
FIT_ROWS, CELLS = 20_000, 1 << 16
#: Pseudo-rows of the usual share, and the least departure from independence in standard deviations.
SHRINK, SIGNIFICANT = 1.0, 5.0
LABELS = ("quality", "toxic")
#: Domains (quality, toxic) and their wanted shares of all tokens.
TARGETS = {(1, 0): 0.900, (0, 0): 0.080, (1, 1): 0.015, (0, 1): 0.005}
STEPS, CLOSE = 30, 1e-4
#: The toxic domains' posterior over which mix() rejects a document.
TOXIC = 0.5


def _name(domain: tuple[int, int]) -> str:
    return f"p_quality{domain[0]}_toxic{domain[1]}"


def _worded(docs: DataFrame) -> DataFrame:
    """Adds lower-case words without end punctuation (``_words``), the distinct ones (``_new``) and n_tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D.,;:!?]+"), lambda w: w != "")
    symbols = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    out = docs.withColumns({"_words": words, "_symbols": symbols}).drop("text")
    return out.withColumns({"_new": F.array_distinct("_words"), "n_tokens": F.size("_words").cast("long")}).drop("_words")


def _cells(worded: DataFrame) -> DataFrame:
    """A row per document and distinct cell: its words, and tokens for the shares of symbols and of new words."""
    tenths = lambda name, a: F.concat(F.lit(f" {name} "), F.least(F.lit(10), F.floor(10 * a / (F.col("n_tokens") + 1))).cast("string"))
    tokens = F.concat(F.col("_new"), F.array(tenths("symbols", F.col("_symbols")), tenths("new", F.size("_new"))))
    rows = worded.withColumn("cell", F.explode(tokens)).drop("_new", "_symbols")
    return rows.withColumn("cell", F.pmod(F.xxhash64("cell"), F.lit(CELLS)).cast("int"))


def _labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """text and labels of the rows to learn from: ``fit_rows`` labelled documents by hash of the id, equal texts once."""
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*[F.max(c).alias(f"_{c}") for c in LABELS])
    there = docs.select(F.col("doc_id").cast("long").alias("_id"))
    known = one.where(" and ".join(f"_{c} in (0, 1)" for c in LABELS)).join(there, "_id", "left_semi")
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(some), "_id")
    return rows.groupBy("text").agg(*[F.max(f"_{c}").alias(f"_{c}") for c in LABELS])


def classifier(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, dict[str, float]]:
    """Weights per cell present, at most CELLS rows, and the log odds of each label with none present."""
    learned = materialise(_labelled(docs, labels, fit_rows), "mixing-fit")
    counts = _cells(_worded(learned)).groupBy("cell").agg(F.count("*").alias("n"), *[F.sum(f"_{c}").cast("long").alias(f"n_{c}") for c in LABELS])
    counts = materialise(counts, "mixing-cells")
    per_row = learned.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(c) for c in LABELS]).first()
    model, rows_n = counts, per_row["n"]
    for c in LABELS:
        yes, no = per_row[c], rows_n - per_row[c]
        n1, n0 = F.col(f"n_{c}"), F.col("n") - F.col(f"n_{c}")
        usual = F.col("n") / max(1, rows_n)
        p1, p0 = (n1 + SHRINK * usual) / (yes + SHRINK), (n0 + SHRINK * usual) / (no + SHRINK)
        absent = F.log(1 - F.least(p1, F.lit(1 - 1e-6))) - F.log(1 - F.least(p0, F.lit(1 - 1e-6)))
        far = F.greatest(F.abs(n1 - usual * yes) / F.sqrt(usual * yes + 1), F.abs(n0 - usual * no) / F.sqrt(usual * no + 1))
        # Only cells that the rarer value has more often: the usual value shows in many ways, such as languages.
        told = (far >= SIGNIFICANT) & ((n1 > usual * yes) if yes <= no else (n0 > usual * no))
        model = model.withColumns({f"w_{c}": F.when(told, F.log(p1 / p0) - absent).otherwise(0.0), f"a_{c}": F.when(told, absent).otherwise(0.0)})
    model = materialise(model.select("cell", *[f"{k}_{c}" for c in LABELS for k in "wa"]).where(" or ".join(f"w_{c} <> 0" for c in LABELS)), "mixing-model")
    absent = model.agg(*[F.coalesce(F.sum(f"a_{c}"), F.lit(0.0)).alias(c) for c in LABELS]).first()
    prior = {c: math.log((per_row[c] + 1) / (rows_n - per_row[c] + 1)) + absent[c] for c in LABELS}
    discard(learned, counts)
    return model.select("cell", *[f"w_{c}" for c in LABELS]), prior


def posteriors(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """row, doc_id, n_tokens and a posterior per domain, for every row of docs in order of scan; ``_hash`` too if docs have it."""
    model, prior = classifier(docs, labels, fit_rows)
    more = [c for c in ("_hash",) if c in docs.columns]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).withColumn("row", F.monotonically_increasing_id())
    cells = _cells(_worded(rows)).select("row", "doc_id", "n_tokens", "cell", *more)
    odds = cells.join(F.broadcast(model), "cell", "left").groupBy("row", "doc_id", "n_tokens", *more).agg(*[F.coalesce(F.sum(f"w_{c}"), F.lit(0.0)).alias(c) for c in LABELS])
    yes = {c: 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col(c) + prior[c])))) for c in LABELS}
    part = lambda c, v: yes[c] if v else 1 - yes[c]
    return odds.select("row", "doc_id", "n_tokens", *more, *[(part("quality", q) * part("toxic", t)).alias(_name((q, t))) for q, t in TARGETS])


def fitted_rate(rows: DataFrame, targets: dict[tuple[int, int], float] = TARGETS, steps: int = STEPS) -> Column:
    """The rate as a function of a row's posteriors. rows: n_tokens and the posteriors, read once a step.

    Residuals are weighed by one over a domain's tokens and the steps taken in the metric of the tokens; then
    posteriors that sum to 1 bound the curvature by 1, and a step of 1 descends.
    """
    names = [_name(d) for d in targets]
    expected = lambda rate: [F.coalesce(F.sum(F.col("n_tokens") * F.col(p) * rate), F.lit(0.0)).alias(p) for p in names]
    rate = F.lit(1.0)
    have = rows.agg(*expected(rate)).first()
    totals = [have[p] for p in names]
    wanted = [sum(totals) * s / sum(targets.values()) for s in targets.values()]
    for _ in range(steps):
        off = [h - w for h, w in zip(have, wanted)]
        if max(abs(r) for r in off) <= CLOSE * max(1.0, sum(totals)):
            break
        move = sum((F.col(p) * F.lit(r / t) for p, r, t in zip(names, off, totals) if t > 0), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - move)
        have = rows.agg(*expected(rate)).first()
    return rate


def rates(docs: DataFrame, labels: DataFrame, targets: dict[tuple[int, int], float] = TARGETS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, n_tokens, the posteriors and the fitted rate of every row."""
    rows = materialise(posteriors(docs, labels, fit_rows).drop("row"), "mixing-posteriors")
    return rows.withColumn("rate", fitted_rate(rows, targets))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[tuple[int, int], float] = TARGETS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents, each as often as its rate says on average: a hash of id and text settles the fraction.

    Documents that are toxic rather than not are rejected by rule; the others keep their domains' proportions.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long"), "text").alias("_hash"))
    rows = materialise(posteriors(hashed, labels, fit_rows).drop("row"), "mixing-posteriors")
    rate = rows.withColumn("rate", fitted_rate(rows, targets))
    toxic = sum((F.col(_name(d)) for d in targets if d[1]), F.lit(0.0)) > TOXIC
    part = F.shiftrightunsigned("_hash", 11) / float(1 << 53)
    whole = F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    copies = rate.groupBy("_hash").agg(F.max(F.when(toxic, 0).otherwise(whole)).cast("int").alias("_copies")).where("_copies > 0")
    h, n, i = (free_name(docs, c) for c in ("_hash", "_copies", "_copy"))
    joined = docs.withColumn(h, F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long"), "text")).join(copies.withColumnsRenamed({"_hash": h, "_copies": n}), h)
    return joined.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
