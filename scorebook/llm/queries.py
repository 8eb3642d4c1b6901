"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, best_fit, common, hilbert, langid, lm, mixing, ngram_join, packing, phrases, quality, secrets, spotsigs, warc


def tokenizer_json() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tiktoken_vocabulary() -> tuple[str, str]:
    """Path of the ranks, and the pattern that cuts a text before merging."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(common.read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_pos")


def op2_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(common.read(spark, sf_dir, "documents"))


def op3_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.read(spark, sf_dir, "documents"), *tiktoken_vocabulary())


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return mixing.rates(docs, common.read(spark, sf_dir, "labels"))


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(common.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeats").alias("n_repeat_words"),
        F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_distance").alias("distance"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(common.read(spark, sf_dir, "documents"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(common.read(spark, sf_dir, "documents"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"), tokenizer_json(), *tiktoken_vocabulary())


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(common.read(spark, sf_dir, "documents"))


def op10_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.read(spark, sf_dir, "documents"))


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(common.read(spark, sf_dir, "documents"))


def op12_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(common.read(spark, sf_dir, "documents"), tokenizer_json(), *tiktoken_vocabulary())


def aligned_vocabularies() -> tuple[str, str, str, str]:
    """Byte-level vocabulary as a tokenizer file and as ranks, its pattern, and the piece model."""
    import public_tokenizers

    return tokenizer_json(), *tiktoken_vocabulary(), public_tokenizers.path("piece_bpe_32k.model")


def op13_spill_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(common.read(spark, sf_dir, "documents"), aligned_vocabularies())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_warc_index_merge, op2_backoff_automaton, op3_token_efficiency, op4_soft_mixing, op5_robust_outliers, op6_ngram_join,
        op7_spotsigs, op8_sum_of_squares_packing, op9_hilbert_shards, op10_cross_parsing, op11_phrase_index,
        op12_minimum_bin_slack, op13_spill_counting, pipeline,
    )
    return {f.__name__: f for f in named}


OP1_SQL = r"""
with p as (
    select page_id, coalesce(url, '') as url, coalesce(html, '') as html,
           strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
    from pages
), k as (
    select *,
           regexp_replace(url, '[\x00-\x20\x7F]', '%20', 'g') as clean,
           case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first
    from p
), h as (
    select *,
           case when regexp_matches(clean, '^[A-Za-z][A-Za-z0-9+.-]*://')
                then array_to_string(list_reverse(string_split(lower(regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '.')), ',') || ')'
                     || case when regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) = '' then '/'
                             else regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) end
                else clean end as url_key
    from k
)
select page_id, payload_bytes, payload_digest,
       case when first < page_id then 'revisit' else 'response' end as record_type,
       case when first < page_id then first end as refers_to,
       url_key,
       row_number() over (order by url_key, page_id) - 1 as history_pos
from h
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index_merge": OP1_SQL}
