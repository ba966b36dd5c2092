"""The thin queries of the corpus operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardline.llm import (byte_bpe, decontaminate, embedding_dedup, language_id, line_dedup, ngram_join, packing,
                           periodic_runs, pii, quality, token_alignment, tokens, url_filter)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule",
                                                "verdict", "p_block")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                              _table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.rate(docs, _table(spark, sf_dir, "labels")).select(
        F.col("row.doc_id").alias("doc_id"), "expected_grade", "p_good", (F.col("p_good") >= quality.LEAST).alias("kept"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_embeddings(_table(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digest(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digest(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_decontamination, op3_quality_classifier, op4_packing, op5_line_dedup, op6_language_id,
    op7_token_counts, op8_ngram_join, op9_pii, op10_embedding_dedup, op11_token_alignment, op12_byte_bpe,
    op13_periodic_runs)}
ORACLE = {"op2_decontamination": decontaminate.ORACLE, "op5_line_dedup": line_dedup.ORACLE,
          "op8_ngram_join": ngram_join.ORACLE}
