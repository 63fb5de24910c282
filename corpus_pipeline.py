"""The corpus pipeline: documents in, a sharded training mixture out.

Stages in order: quality rules, near-duplicate removal, benchmark decontamination, mixing sources to
target weights, sharding. Each stage works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, near_dup, quality, sharding
from tidemark.llm.storage import materialise

#: Mixing draws from a seeded hypergeometric law, which SQL can't express; tests/llm compares with brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return quality.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class."""
    return near_dup.drop_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target weight asks for, shuffled."""
    return mixing.mixture(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot."""
    return sharding.shard_rows(docs)


STAGES = [("quality", keep_good), ("near_dedup", drop_near_copies), ("decontaminate", drop_benchmark_leaks), ("mix", mix_sources), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
