"""The registered queries of this package and their SQL where DuckDB can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import (
    embedding_dedup,
    language_id,
    line_dedup,
    ngram_join,
    oracles,
    packing,
    personal_data,
    piece_tokens,
    quality_rules,
    substring_dedup,
    toxicity,
    url_filters,
    vector_codes,
    whitening,
)
from tallyweave.llm.common import read


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, url_filters.default_rules()).drop("url")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_query(read(spark, sf_dir, "embeddings"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_query(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_query(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_query(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_query(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_query(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_query(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.token_query(read(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data_query(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_query(read(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_query(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_piece_tokens": op10_piece_tokens,
    "op11_personal_data": op11_personal_data,
    "op12_vector_codes": op12_vector_codes,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filters.oracle(),
    "op2_embedding_dedup": oracles.EMBEDDING,
    "op3_ngram_join": oracles.JACCARD,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_quality_rules": oracles.QUALITY,
    "op8_substring_dedup": oracles.SUBSTRING,
    "op12_vector_codes": oracles.vector_codes_sql(),
}
