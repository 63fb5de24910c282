"""Data checks: each returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def outside(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def missing(rows: DataFrame, *columns: str) -> DataFrame:
    """(column, n) of the columns that hold nulls."""
    counts = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns))).alias("x")).select("x.*").where("n > 0")


def without_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def held_out_floor(rows: DataFrame, least: int = 15) -> int:
    """The number of held-out rows; fewer than ``least`` abort."""
    n = rows.agg(F.count_if("is_held_out")).first()[0]
    if n < least:
        raise ValueError(f"only {n} rows are held out, {least} are needed")
    return n


def load_check(written: DataFrame, loaded: DataFrame, embedding: str) -> None:
    """Fails unless both sides have as many rows and as many embeddings."""
    counts = [tuple(df.agg(F.count("*"), F.count(embedding)).first()) for df in (written, loaded)]
    if counts[0] != counts[1]:
        raise ValueError(f"{counts[1]} rows and embeddings are loaded, {counts[0]} were written")


def artifact_problems(artifacts: DataFrame, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """(name, problem) of JSON artifacts (name, body): no object, fields that their name's prefix requires, several versions, repeated ordinals, a dirty tree."""
    rows = artifacts.withColumn("v", F.try_parse_json("body"))
    text = lambda path: F.try_variant_get("v", path, "string")
    broken = rows.where("v IS NULL").select("name", F.lit("no JSON").alias("problem"))
    rules = rows.sparkSession.createDataFrame([(p, f) for p, fields in required.items() for f in fields], "prefix string, field string")
    held = rows.where("v IS NOT NULL").select("name", F.map_keys(F.coalesce(F.try_variant_get("v", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))).alias("fields"))
    lacking = held.join(F.broadcast(rules), F.startswith("name", "prefix")).where(~F.array_contains("fields", F.col("field"))).select("name", F.concat(F.lit("lacks "), "field").alias("problem"))
    dirty = rows.where(F.try_variant_get("v", "$.dirty", "boolean")).select("name", F.lit("dirty tree").alias("problem"))
    facts = rows.select("name", text("$.version").alias("version"), text("$.ordinal").alias("ordinal"))
    versions = facts.where("version IS NOT NULL").agg(F.count_distinct("version").alias("n"), F.min("version").alias("least")).where("n > 1").select(F.lit("*").alias("name"), F.lit("several versions").alias("problem"))
    ordinals = repeated_keys(facts.where("ordinal IS NOT NULL"), "ordinal").select(F.lit("*").alias("name"), F.concat(F.lit("repeated ordinal "), "ordinal").alias("problem"))
    return broken.union(lacking).union(dirty).union(versions).union(ordinals)
