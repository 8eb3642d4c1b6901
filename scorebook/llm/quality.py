"""Quality rules with robust multivariate outliers, on DataFrame functions alone.

Each text gives a few counts. Two fixed rules fail texts that are too short or repeat themselves. For the
rest, transformed statistics form a vector per text; per language and source, location and scatter come from
the minimum-covariance-determinant method: from several starts, concentration steps keep the 75 % of rows with
the smallest Mahalanobis distance and estimate again from those, until no determinant falls any more; the estimate
with the least determinant counts. Texts beyond a chi-square cut-off of the final distance are rejected.

Counts per text need no shuffle. A step is one pass for all groups and starts: sums and products per bin of the
distance, combined before the shuffle, so a hot source costs no more than others; which bins are within the 75 % is
settled on those sums. Models and pools are written, so they are broadcast if they are small and joined otherwise.
A source with fewer than ``MIN_ROWS`` texts in a language is pooled with the language's other small sources,
and those with the rest, if they are still too few; the rest needs ``LEAST_ROWS`` only.

Defined results: null text has no words and fails; null language or source is a value of its own; repeated rows
count once each; a rest under ``LEAST_ROWS`` rejects nothing by distance; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, materialise

WINDOW = 5
MIN_ROWS = 200
#: The least rows of the pool of all the rest, ten for each statistic.
LEAST_ROWS = 40
KEPT_SHARE = 0.75
#: Concentration steps at most, and the fall of a log determinant that calls for another.
STEPS, FALL = 20, 1e-3
#: Upper tail of the chi-square distribution beyond which a text is an outlier.
TAIL = 1e-3
#: Least standard deviation of each statistic, so that one that is constant in a group rejects no small change; each
#: so small that the statistic alone can reach the cut before base_failed() does.
FLOORS = {"f_length": 0.08, "f_symbols": 0.5, "f_lines": 0.15, "f_repeats": 0.07}
FEATURES = list(FLOORS)


def statistics(docs: DataFrame) -> DataFrame:
    """All columns of docs and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (prefixed q_)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_words": words, "_lines": lines})
    n = F.size("_words")
    at = lambda i, k: F.get(F.col("_words"), i + k)
    grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    out = out.withColumn("_grams", F.when(n > WINDOW, grams))
    repeated = F.size(F.array_distinct("_grams")) < F.size("_grams")
    out = out.withColumn("_sorted", F.when(repeated, F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, i: F.coalesce(F.get(F.col("_sorted"), i)["h"] == x["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: near(x, i - 1) | near(x, i + 1))
    out = out.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    gaps = F.zip_with(F.slice("_at", 2, F.size("_at")), F.slice("_at", 1, F.size("_at") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)
    return out.withColumns({
        "q_words": n.cast("long"),
        "q_word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "q_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "q_lines": F.size("_lines").cast("long"),
        "q_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "q_repeats": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("_words", "_lines", "_grams", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("q_words") < 10) | (100 * F.col("q_repeats") > 20 * F.col("q_words"))


def features() -> dict[str, Column]:
    """Transformed statistics; the added constants draw those of short texts to usual values."""
    n = F.col("q_words")
    return {
        "f_length": F.log((F.col("q_word_chars") + 250) / (n + 50)),
        "f_symbols": F.log1p(100 * F.col("q_symbols") / (n + 20)),
        "f_lines": F.sqrt(F.col("q_dup_lines") / (F.col("q_lines") + 5)),
        "f_repeats": F.sqrt(F.col("q_repeats") / (n + 20)),
    }


def chi_square(x: float, df: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(df // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi_square_cut(p: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, df) < p else (lo, mid)
    return lo


def grouped(rows: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """``g``: language and source, or the pool that stands in for small ones; null for a rest under LEAST_ROWS."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    own = F.concat_ws("\x1f", named("lang"), named("source"))
    sizes = rows.groupBy(own.alias("_own"), named("lang").alias("_lang")).agg(F.count("*").alias("n"))
    # One small row per language and source: the pools are settled on these.
    pooled = sizes.withColumn("_pool", F.when(F.col("n") >= least, F.col("_own")).otherwise(F.concat(F.lit("pool\x1f"), "_lang")))
    per_pool = pooled.groupBy("_pool").agg(F.sum("n").alias("m"))
    pooled = pooled.join(per_pool, "_pool").withColumn("g", F.when(F.col("m") >= least, F.col("_pool")).otherwise("rest"))
    rest = pooled.groupBy("g").agg(F.sum("n").alias("k")).where(F.col("k") >= min(least, LEAST_ROWS))
    pooled = materialise(pooled.join(rest, "g").select("_own", "g"), "quality-pools")
    return rows.withColumn("_own", own).join(pooled, "_own", "left").drop("_own")


def _distance(model: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor in the row."""
    y: list[Column] = []
    for i, f in enumerate(FEATURES):
        v = F.col(f) - F.col(f"m_{i}")
        for j in range(i):
            v = v - F.col(f"l_{i}{j}") * y[j]
        y.append(v / F.col(f"l_{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _products() -> list[tuple[str, Column]]:
    p = len(FEATURES)
    out = [(f"m_{i}", F.col(f)) for i, f in enumerate(FEATURES)]
    return out + [(f"s_{i}{j}", F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in range(p) for j in range(i + 1)]


def _factor(moments: DataFrame, scale: float) -> DataFrame:
    """g, start, mean, Cholesky factor of the scaled covariance, and its log determinant. moments: means m_i and s_ij."""
    p = len(FEATURES)
    model = moments
    for i in range(p):
        for j in range(i + 1):
            v = (F.col(f"s_{i}{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * scale
            if i == j:
                v = F.greatest(v, F.lit(0.0)) + FLOORS[FEATURES[i]] ** 2
            for k in range(j):
                v = v - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            model = model.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l_{j}{j}"))
    return _shaped(model)


def _shaped(model: DataFrame) -> DataFrame:
    p = len(FEATURES)
    logdet = 2 * sum((F.log(f"l_{i}{i}") for i in range(1, p)), F.log("l_00"))
    return model.select("g", "start", *[f"m_{i}" for i in range(p)], *[f"l_{i}{j}" for i in range(p) for j in range(i + 1)], logdet.alias("logdet"))


def _starts(rows: DataFrame) -> DataFrame:
    """Medians with quartile ranges (0), medians with the least scales (1), and means with covariances (2)."""
    p = len(FEATURES)
    one = rows.select("g", F.posexplode(F.array(*FEATURES)).alias("f", "v"))
    bins = materialise(one.groupBy("g", "f", F.floor(F.col("v") / 0.005).alias("bin")).agg(F.count("*").alias("n")), "mcd-bins")
    whole = Window.partitionBy("g", "f")
    bins = bins.withColumns({"at": F.sum("n").over(whole.orderBy("bin")), "all": F.sum("n").over(whole)})
    reach = lambda q: (F.min(F.when(F.col("at") >= q * F.col("all"), F.col("bin"))) + 1) * 0.005
    q = bins.groupBy("g", "f").agg(reach(0.25).alias("lo"), reach(0.5).alias("mid"), reach(0.75).alias("hi"))
    of = lambda i, c: F.max(F.when(F.col("f") == i, F.col(c)))
    wide = q.groupBy("g").agg(*[of(i, "mid").alias(f"m_{i}") for i in range(p)], *[(of(i, "hi") - of(i, "lo")).alias(f"_{i}") for i in range(p)])
    out = _factor(rows.groupBy("g").agg(F.lit(2).alias("start"), *[F.avg(v).alias(k) for k, v in _products()]), 1.0)
    for start in (0, 1):
        own = wide.withColumn("start", F.lit(start)).withColumns({f"l_{i}{j}": F.lit(0.0) for i in range(p) for j in range(i)})
        least = {i: F.lit(FLOORS[f]) for i, f in enumerate(FEATURES)}
        own = own.withColumns({f"l_{i}{i}": least[i] if start else F.greatest(F.col(f"_{i}") / 1.349, least[i]) for i in range(p)})
        out = out.unionByName(_shaped(own))
    # A start's determinant is not one of 75 % of the rows: the first step's counts in any case.
    out = materialise(out.withColumn("logdet", F.lit(1e9)), "mcd-model")
    discard(bins)
    return out


def _concentrated(rows: DataFrame, model: DataFrame, scale: float) -> DataFrame:
    """The estimates from the rows nearest to the model, the share KEPT_SHARE of each group."""
    # Logarithms, in steps of 2 %, hold any distance in few bins.
    far = rows.join(model.drop("logdet"), "g").withColumn("bin", F.floor(F.log(_distance() + 1e-6) / 0.02))
    bins = materialise(far.groupBy("g", "start", "bin").agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in _products()]), "mcd-bins")
    whole = Window.partitionBy("g", "start")
    inner = bins.withColumns({"at": F.sum("n").over(whole.orderBy("bin")), "all": F.sum("n").over(whole)})
    inner = inner.where(F.col("at") - F.col("n") < KEPT_SHARE * F.col("all"))
    after = materialise(_factor(inner.groupBy("g", "start").agg(*[(F.sum(k) / F.sum("n")).alias(k) for k, _ in _products()]), scale), "mcd-model")
    discard(bins)
    return after


def fit(rows: DataFrame) -> DataFrame:
    """The robust location and scatter of each group, one row each. rows: g and the features."""
    p = len(FEATURES)
    rows = rows.where("g is not null")
    inner_cut = chi_square_cut(KEPT_SHARE, p)
    scale = KEPT_SHARE / chi_square(inner_cut, p + 2)
    model = _starts(rows)
    for _ in range(STEPS):
        after = _concentrated(rows, model, scale)
        before = model.select("g", "start", F.col("logdet").alias("before"))
        falls = after.join(before, ["g", "start"]).agg(F.max(F.col("before") - F.col("logdet")).alias("most")).first()["most"]
        discard(model)
        model = after
        if falls is None or falls <= FALL:
            break
    names = [c for c in model.columns if c not in ("g", "start")]
    least = model.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("m"))
    return materialise(least.select("g", "m.*"), "mcd-model")


def assess(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Counts and verdict per row; with ``carry`` the row of docs too, as the struct ``_doc``.

    q_words ... q_repeats, q_base_failed, q_distance (null where no group is large enough) and q_kept.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if carry else []
    stats = statistics(docs.select("doc_id", "text", "lang", "source", *whole)).drop("text")
    stats = materialise(stats, "quality-stats")
    rows = grouped(stats.withColumns(features()))
    model = fit(rows.where(~base_failed()).select("g", *FEATURES))
    judged = rows.join(model, "g", "left").withColumn("q_distance", _distance())
    cut = chi_square_cut(1 - TAIL, len(FEATURES))
    judged = judged.withColumn("q_base_failed", base_failed())
    judged = judged.withColumn("q_kept", ~F.col("q_base_failed") & F.coalesce(F.col("q_distance") <= cut, F.lit(True)))
    drop = [*FEATURES, "g", *[c for c in model.columns if c != "g"]]
    return judged.drop(*drop)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep."""
    return assess(docs, carry=True).where("q_kept").select("_doc.*")
