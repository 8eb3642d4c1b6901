"""SpotSigs fingerprints on DataFrame functions alone.

Each common word of a text (an anchor) starts a chain of the next content words; chains are the text's
signatures. Signature sets are partitioned by length, because sets whose lengths differ by more than the
threshold allows cannot be alike, and compared by Jaccard similarity only if they share one of their rarest
signatures and their lengths leave it possible.

Defined results: null text is empty; a text without chains has one signature, its whole self, so that equal
texts have equal fingerprints and other such texts share nothing; of rows with equal ids each is compared, in
order of the text; a null id comes last; an empty table gives no rows. Whole texts count, of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise

# Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "the of and to in is that it for on as with be by this are at from or "
    "der die das und ist von den dem zu ein eine nicht mit auf für "
    "le la les de des du et en un une que qui est pour dans au "
    "el los las y del se con por una es no para"
).split()
CHAIN = 2
THRESHOLD = 0.75


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where a lambda in ``use`` asks for it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct 40-bit hashes of the text's chains.

    The text is cut behind each content word, in one pass: a piece is a run of anchors and the content word after it, so the
    chain of each of its anchors is its own content word and those of the next pieces. Time grows with the text's length alone.
    """
    anchor = "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w)))
    plain = F.concat(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")), F.lit(" "))
    # anchors at the end, with no content word behind them, match nothing, and \G stops the search there
    found = F.regexp_extract_all(plain, F.lit(rf"\G((?:(?:{anchor})\x20)*+[^\x20]+)\x20"), F.lit(1))

    def hashed(pieces: Column) -> Column:
        def of(piece: Column, at: Column) -> Column:
            tail = F.concat_ws(" ", *[F.element_at(F.get(pieces, at + k), -1) for k in range(chain)])
            whole = (F.size(piece) > 1) & (at + (chain - 1) < F.size(pieces))
            own = F.array_distinct(F.slice(piece, 1, F.size(piece) - 1))
            return F.when(whole, F.transform(own, lambda a: F.shiftrightunsigned(F.xxhash64(F.concat(a, F.lit(" "), tail)), 24)))

        return F.flatten(F.filter(F.transform(pieces, of), lambda x: x.isNotNull()))

    signs = F.array_sort(F.array_distinct(_bound(F.transform(found, lambda p: F.split(p, " ")), hashed)))
    return _bound(signs, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(text), 24))))


def fingerprint(signs: Column) -> Column:
    """Set length, then the signatures in hex: the whole set, so likeness can be read from two fingerprints."""
    return F.concat(F.size(signs).cast("string"), F.lit(":"), F.array_join(F.transform(signs, lambda h: F.hex(h)), "."))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _dealt(docs: DataFrame) -> DataFrame:
    """Rows in ranges of falling doc_id (``part``), each followed by a copy of the row that opens the next range."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("_key"))
    ids = docs.select(key.alias("_key"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in ids.approxQuantile("_key", [i / n for i in range(1, n)], 0.2 / n)})
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    part = F.size(F.filter(bounds, lambda c: c <= F.col("_key")))
    first = {r["part"]: r["first"] for r in ids.select(part.alias("part"), "_key").groupBy("part").agg(F.max("_key").alias("first")).collect()}
    order = sorted(first, reverse=True)
    opens = [(p, first[p], order[i - 1]) for i, p in enumerate(order)]  # also a copy for the range before; the last range precedes the first
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("copy"))
    places = F.array(own)
    if opens:
        where = F.create_map([F.lit(x) for p, k, to in opens for x in (p, F.struct(F.lit(k).cast("long").alias("k"), F.lit(to).alias("to")))])
        at = where[F.col("_part")]
        copy = F.struct(at["to"].alias("part"), F.lit(True).alias("copy"))
        places = F.when(F.col("_key") == at["k"], F.array(own, copy)).otherwise(places)
    return rows.withColumn("_part", part).withColumn("_at", F.explode(places)).select("doc_id", "text", "_key", F.col("_at.part").alias("part"), F.col("_at.copy").alias("copy"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each text against its edited text and against the next document, in falling order of id."""
    rows = Window.partitionBy("part").orderBy("copy", F.desc("_key"), "text")
    found = _dealt(docs).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_next", F.lead("text").over(rows))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.expr("substring(_next, 1, cast(n_chars div 2 as int))"))
    found = found.withColumn("_signs", signatures(F.col("text"))).withColumn("_edited", F.when(~F.col("copy"), edited))
    found = found.withColumn("_next_signs", F.lead("_signs").over(rows)).where(~F.col("copy"))
    found = found.withColumn("_edited_signs", signatures(F.col("_edited")))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("_signs")).alias("fingerprint"), fingerprint(F.col("_edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("_signs"), F.col("_edited_signs")).alias("near_edited"), likeness(F.col("_signs"), F.col("_next_signs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, likeness) of different signature sets, each named by its smallest doc_id, at the threshold or above.

    Equal sets are one. A set is in the partition of its length and, for shorter partners, in the one below;
    of its signatures the rarest floor((1 - t) n) + 1 are join keys.
    """
    signs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.coalesce(F.col("text"), F.lit(""))).alias("signs"))
    sets = materialise(signs.groupBy("signs").agg(F.min("doc_id").alias("id")).select("id", "signs", F.size("signs").alias("n")), "spotsigs-sets")
    rows = sets.select("id", "n", F.explode("signs").alias("sign"))
    often = rows.groupBy("sign").agg(F.count("*").alias("often"))
    by_id = Window.partitionBy("id").orderBy("often", "sign")
    keys = rows.join(often, "sign").withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= F.floor((1 - threshold) * F.col("n") + 1e-9) + 1)
    width = F.log(F.lit(1 / threshold))
    keys = materialise(keys.withColumn("part", F.floor(F.log("n") / width + 1e-9)).select("id", "n", "sign", "part"), "spotsigs-keys")
    short = keys.select(F.col("id").alias("a"), F.col("n").alias("na"), "sign", "part")
    long = keys.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sign", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    fits = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = short.join(long, ["part", "sign"]).where(fits & (F.col("na") >= threshold * F.col("nb"))).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("signs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("signs").alias("y")), "b")
    return both.select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= threshold)
