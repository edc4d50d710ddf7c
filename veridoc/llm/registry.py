"""The registered queries of these operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import bpe, html_text, jaccard, matroska, mixing, quality, records, secrets, suffix_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages", "page_id", "url", "html"), keep=["page_id", "url"])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), keep=["doc_id"])


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_groups(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.roundtrip(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_html_extraction, op3_source_mixing, op4_byte_bpe, op5_media_columns, op6_tokeniser_fertility, op7_suffix_array_dedup, op8_ngram_jaccard_join, op9_token_records, op10_secret_scans)}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.sql(), "op7_suffix_array_dedup": suffix_dedup.sql(), "op8_ngram_jaccard_join": jaccard.sql()}
