"""Registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, html_main, licenses, mixing, near_dup, pii, quality, quality_knn, ranked_search, sharding, spelling, storage, token_store, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return storage.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.score(_table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dup.classes(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("is_first"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), ["doc_id"])


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), ["doc_id"])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = storage.materialise(ranked_search.build(_table(spark, sf_dir, "documents")), "signatures")
    return ranked_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_near_duplicates, op3_sharding, op4_licenses, op5_main_text, op6_decontamination, op7_token_counts, op8_quality_rules, op9_personal_data, op10_token_store, op11_lexical_search, op12_spelling_variants, op13_quality_votes)}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": decontaminate.ORACLE_SQL, "op11_lexical_search": ranked_search.ORACLE_SQL}
