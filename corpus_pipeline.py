"""The corpus pipeline: documents through quality rules, near-duplicate join, secret scan, mixing and packing.

Each stage takes documents (doc_id, text, lang, source, n_chars, and any further columns, whatever their names) and all but the
last return the same columns. Null and empty texts have no words, so the rules reject them; a null lang or source is a group of
its own. Repeated rows are judged alike in every stage that keeps or drops; the join leaves one row of an id and a text, and
keeps all rows without an id. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.llm import common, mixing, ngram_join, packing, quality, queries, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, of repeated rows all or none; texts of under ten words go, null and empty ones too."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, repeated rows once; rows without words or id stay."""
    return ngram_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars to match; a null text stays null."""
    return secrets.redact(docs, *queries.tiktoken_vocabulary()).withColumn("n_chars", F.char_length("text").cast("long"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says on average, equal rows alike; toxic ones not at all."""
    return mixing.mix(docs, common.read(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens, one for an empty or null text; a null doc_id is carried."""
    return packing.pack(docs, queries.tokenizer_json(), *queries.tiktoken_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing to target weights", mixing_to_targets),
    ("packing", pack),
]

#: A minimum-covariance fit, components and tokenisers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's rows are written and read again as the next one's documents."""
    docs = common.read(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        after = common.materialise(stage(spark, docs, sf_dir), "pipeline")
        if before is not None:
            common.discard(before)
        docs = before = after
    return docs
