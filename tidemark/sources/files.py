"""Readers and writers: markdown trees, Parquet, JSON lines, caches, sheets, artifacts, change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.hashing import check_fingerprint
from tidemark.operators.chunking import front_matter

TICKET = (
    "number bigint, title string, body string, labels array<struct<name:string>>, created_at string, closed_at string, url string,"
    " closing_nodes array<struct<number:bigint,url:string,merged:boolean,repository:struct<nameWithOwner:string>>>"
)

DRAFT = "query_id bigint, probable_cause string, suggested_fix string, citations array<struct<source:string,url:string,quote:string>>, clarifying_questions array<string>"
#: A page change, and what the ledger keeps of it.
CHANGE = "seq bigint, change_type string, path string, old_path string, n_chunks bigint, payload string"
LEDGER = "seq bigint, path string, change_type string, old_path string, chunks_before bigint, chunks_after bigint"


def whole_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(name, body) of each file below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")).select(F.element_at(F.split("file", "/"), -1).alias("name"), "file", "body")


def markdown_tree(spark: SparkSession, folder: str, drafts: bool = False) -> DataFrame:
    """(path, markdown) of all pages below a folder, without drafts; path is relative to the folder."""
    top = folder.rstrip("/") + "/"
    path = F.element_at(F.split("file", F.concat(F.lit(r"\Q"), F.lit(top.split(":", 1)[-1].lstrip("/")), F.lit(r"\E")), 2), -1)
    rows = whole_files(spark, folder, "*.md").select(path.alias("path"), F.col("body").alias("markdown"))
    if drafts:
        return rows
    return rows.join(front_matter(rows).where("draft").select("path"), "path", "left_anti")


def write_corpus(pages: DataFrame, chunks: DataFrame, folder: str) -> None:
    """Both tables as Parquet; a reload replaces them."""
    pages.write.mode("overwrite").parquet(f"{folder}/pages")
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")


def read_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/pages"), spark.read.parquet(f"{folder}/chunks")


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """Issue records from JSON lines."""
    return spark.read.schema(TICKET).json(path)


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Dumped drafts, one record a ticket."""
    return spark.read.schema(DRAFT).json(path)


def reset_corpus(base: DataFrame, folder: str, key: str, text: str, fingerprint: tuple[int, str]) -> DataFrame:
    """Puts the base snapshot back as ``folder/pages`` with an empty change log and ledger, and returns it; fails unless it has the fingerprint that was recorded."""
    base.write.mode("overwrite").parquet(f"{folder}/pages")
    spark = base.sparkSession
    for name, schema in (("changes", CHANGE), ("ledger", LEDGER)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}")
    pages = spark.read.schema(base.schema).parquet(f"{folder}/pages")
    check_fingerprint(pages, key, text, fingerprint)
    return pages


def write_json_lines(rows: DataFrame, path: str, *order: str) -> None:
    """One record a line, sorted over the files if an order is given."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """A JSON object with any keys as rows: the key, and the fields of its value (a DDL struct)."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{value}>>").alias("m"))
    return rows.select(F.explode("m").alias(key, "v")).select(key, "v.*")


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, body) of JSON files of any shape."""
    return whole_files(spark, folder, "*.json").select("name", "body")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a change feed whose lines start with their number and a tab."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.try_to_number(parts[0], F.lit("999999999999")).cast("bigint").alias("seq"), parts[1].alias("line")).where("seq IS NOT NULL")
