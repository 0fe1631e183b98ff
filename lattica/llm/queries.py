"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, html_extract, katz, language, license_scan, mixing, near_dedup, quality, sql, suffix_dedup, vector_search
from lattica.llm.common import crc_mod, table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"), min_bytes=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.report(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda doc_id: crc_mod(doc_id, 3) == 1
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) == 2).drop("shares")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.report(table(spark, sf_dir, "pages"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.top_k(vectors.filter("vec_id % 100 = 0"), vectors, k=10)


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_suffix_dedup, op3_near_dedup, op4_license_scan, op5_katz, op6_decontaminate, op7_quality, op8_language_id, op9_html_main_text, op10_exact_top_k)}

ORACLE: dict[str, str] = {"op2_suffix_dedup": sql.SUFFIX_DEDUP, "op3_near_dedup": sql.NEAR_DEDUP, "op6_decontaminate": sql.DECONTAMINATE, "op10_exact_top_k": vector_search.ORACLE}
