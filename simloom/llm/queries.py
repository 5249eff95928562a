"""The registered queries ``opN_<name>`` and their DuckDB twins.

Each query applies its operator to its whole table with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from simloom.llm import bpe, decontaminate, language_id, line_dedup, media, ngram_join, quality, secret_scan, token_ids, url_filter
from simloom.llm.shared import documents


def tokenizer_file(name: str) -> str:
    """Where an installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_report(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_report(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontamination_report(documents(spark, sf_dir), benchmark)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_ids": op4_token_ids,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_bpe": op6_bpe,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_url_filter": op10_url_filter,
}
