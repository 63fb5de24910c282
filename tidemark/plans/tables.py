"""Test tables read as the corpora that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import hashing
from tidemark.operators import fulltext
from tidemark.sources.shared import spread

#: Every how many ids a row is a query.
QUERY_MOD = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, vec, label, tenant_id) of all embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label", hashing.tenant_of(F.col("vec_id")).alias("tenant_id"))


def vector_queries(corpus: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by QUERY_MOD."""
    return corpus.where(F.col("key") % QUERY_MOD == 0).select(F.col("key").alias("query_id"), F.col("vec").alias("qvec"), "tenant_id", F.col("label").alias("query_label"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, text, tenant_id) of all documents."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("key"), "text", hashing.tenant_of(F.col("doc_id")).alias("tenant_id"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, terms, tenant_id): all benchmark items as queries."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("query_id"), fulltext.query_terms(F.col("text")).alias("terms"), hashing.tenant_of(F.col("item_id")).alias("tenant_id"))


def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, title, body): the first user turn of each conversation as a ticket; its first line is the title."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    cut = F.instr("text", "\n")
    text = F.coalesce("text", F.lit(""))
    return first.select(F.col("conv_id").alias("number"), F.when(cut > 0, F.substr(text, F.lit(1), cut - 1)).otherwise(text).alias("title"), F.when(cut > 0, F.substr(text, cut + 1)).otherwise("").alias("body"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as page changes: the user is the page, the event id the order, the value the size."""
    kinds = {"signup": "added", "view": "modified", "click": "modified", "error": "deleted", "purchase": "renamed"}
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")]
    page = F.col("user_id").cast("string")
    renamed = F.col("event_type") == "purchase"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), kind.alias("change_type"), F.when(renamed, (F.col("user_id") + 1000).cast("string")).otherwise(page).alias("path"), F.when(renamed, page).alias("old_path"),
        (F.floor("value").cast("bigint") % 7 + 1).alias("n_chunks"), F.col("props").alias("payload"),
    )


#: The same tables as DuckDB common table expressions.
SQL_TENANT = "(('0x' || substr(sha256('tenant:' || {0}), 1, 16))::UBIGINT % 50)::INT"
SQL_VECTORS = f"v AS (SELECT vec_id AS key, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label, {SQL_TENANT.format('vec_id')} AS tenant_id FROM embeddings), q AS (SELECT key AS query_id, vec AS qvec, tenant_id, label AS query_label FROM v WHERE key % {QUERY_MOD} = 0)"
SQL_STOPS = "[" + ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS) + "]"
SQL_TICKETS = r"""t AS (SELECT conv_id AS number, CASE WHEN instr(x, chr(10)) > 0 THEN substr(x, 1, instr(x, chr(10)) - 1) ELSE x END AS title, CASE WHEN instr(x, chr(10)) > 0 THEN substr(x, instr(x, chr(10)) + 1) ELSE '' END AS body
  FROM (SELECT conv_id, coalesce(arg_min(text, turn), '') AS x FROM conversations WHERE role = 'user' GROUP BY conv_id))"""
SQL_CHANGES = """c AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'renamed' ELSE 'modified' END AS change_type,
  CASE WHEN event_type = 'purchase' THEN (user_id + 1000)::VARCHAR ELSE user_id::VARCHAR END AS path, CASE WHEN event_type = 'purchase' THEN user_id::VARCHAR END AS old_path,
  floor(value)::BIGINT % 7 + 1 AS n_chunks, props AS payload FROM events),
o AS (SELECT path, seq, 1 AS op_no, CASE WHEN change_type = 'deleted' THEN 0 ELSE n_chunks END AS n_chunks, payload, change_type <> 'deleted' AS live FROM c
  UNION ALL SELECT old_path, seq, 0, 0, NULL, false FROM c WHERE change_type = 'renamed')"""
