"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shoalwater.llm import byte_bpe, exact_dedup, language_id, paragraph_dedup, pii, secrets, simhash, source_mix, url_lists, webp_lossless

#: The rank file of the registered query; a parameter of the operator.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source to 150 % of their words."""
    return source_mix.mix_sources(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, judged by how many sources hold them."""
    return secrets.find_secrets(documents(spark, sf_dir))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the dated list entries active on its fetch day."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = url_lists.judge_captures(url_lists.captures_of(pages), url_lists.sample_events(pages))
    return judged.withColumns({c: judged[c].cast("string") for c in ("fetched", "since")})


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the component of each."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_webp_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as lossless WebP and read back."""
    return webp_lossless.digests(webp_lossless.decode_column(webp_lossless.encode_column(documents(spark, sf_dir))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    return language_id.identify(documents(spark, sf_dir))


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that repeats, exactly or nearly, and every passage that repeats inside lines."""
    return paragraph_dedup.repeats(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text, encoded and decoded again."""
    tokenizer = byte_bpe.Tokenizer(spark, RANKS, public_tokenizers.PATTERN, byte_bpe.REMEMBER_MORE)
    return tokenizer.round_trip(documents(spark, sf_dir), keep_ids=False)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.find_personal(documents(spark, sf_dir))


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_url_lists": op4_url_lists,
    "op5_simhash": op5_simhash,
    "op6_webp_lossless": op6_webp_lossless,
    "op7_language_id": op7_language_id,
    "op8_paragraph_dedup": op8_paragraph_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_pii": op10_pii,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_secret_scan": secrets.ORACLE,
    "op4_url_lists": url_lists.ORACLE,
}
