"""Queries on hashing, text columns, chunking and sources."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import hashing, text
from tidemark.operators import chunking, tickets
from tidemark.plans import tables as T
from tidemark.plans.registry import register
from tidemark.sources import files
from tidemark.sources.shared import table_path


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return table_path(spark, "scratch")


@register("tenant_holdout", f"SELECT doc_id, {T.SQL_TENANT.format('doc_id')} AS tenant_id, ('0x' || substr(sha256('heldout:' || doc_id), 1, 16))::UBIGINT % 10 = 0 AS is_held_out FROM documents")
def tenant_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return T.table(spark, sf_dir, "documents").select("doc_id", hashing.tenant_of(n).alias("tenant_id"), hashing.is_held_out(n).alias("is_held_out"))


@register("tenant_counts", f"WITH c AS (SELECT {T.SQL_TENANT.format('doc_id')} AS t, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT coalesce(n, 0) AS n FROM range(50) r LEFT JOIN c ON c.t = r.range) SELECT count(*) AS n_tenants, min(n) AS least, max(n) AS most, avg(n) AS mean FROM a")
def tenant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.evaluation import tenant_counts as counts

    return counts(T.texts(spark, sf_dir), 50)


@register("spot_sample", "SELECT doc_id, source FROM (SELECT doc_id, source FROM documents ORDER BY sha256('spot:' || doc_id) LIMIT 30)")
def spot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 30 rows are the feature."""
    return hashing.hash_sample(T.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@register("conversation_hashes", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS content_hash FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def conversation_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.content_hashes(T.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@register("corpus_fingerprint", """WITH r AS (SELECT md5(doc_id || '|' || md5(coalesce(text, ''))) AS h FROM documents), s AS (SELECT count(*) AS n_rows, sum(('0x' || substr(h, 1, 7))::BIGINT)::BIGINT AS a, sum(('0x' || substr(h, 8, 7))::BIGINT)::BIGINT AS b FROM r)
SELECT n_rows, substr(md5(n_rows || '|' || a || '|' || b), 1, 12) AS fingerprint FROM s""")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.fingerprint(T.table(spark, sf_dir, "documents"), "doc_id", "text")



@register("page_images", f"SELECT page_id, list_concat(list_concat(regexp_extract_all(coalesce(html, ''), {_re(text.IMAGE_REFS[0])}, 1), regexp_extract_all(coalesce(html, ''), {_re(text.IMAGE_REFS[1])}, 1)), regexp_extract_all(coalesce(html, ''), {_re(text.IMAGE_REFS[2])}, 1)) AS refs, coalesce(regexp_matches(html, {_re('|'.join(text.TICKET_IMAGES))}), false) AS has_images FROM pages")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return T.table(spark, sf_dir, "pages").select("page_id", text.image_refs(html).alias("refs"), text.has_images(html).alias("has_images"))


@register("ticket_columns", rf"""WITH {T.SQL_TICKETS} SELECT number, {T.SQL_TENANT.format('number')} AS tenant_id, ('0x' || substr(sha256('heldout:' || number), 1, 16))::UBIGINT % 10 = 0 AS is_held_out, coalesce(regexp_matches(body, {_re('|'.join(text.TICKET_IMAGES))}), false) AS has_images,
  substr(regexp_replace(title || chr(10) || chr(10) || regexp_replace(body, '(?s)```.*?```', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 1600) AS embed_text FROM t""")
def ticket_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets.derive(T.first_turns(spark, sf_dir)).select("number", "tenant_id", "is_held_out", "has_images", "embed_text")


@register("query_texts", f"WITH {T.SQL_TICKETS} SELECT number, title || chr(10) || substr(body, 1, 500) AS query_text FROM t")
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.first_turns(spark, sf_dir).select("number", text.query_text(F.col("title"), F.col("body")).alias("query_text"))


@register("captioned_texts", rf"""WITH {T.SQL_TICKETS}, a AS (SELECT conv_id AS number, string_agg(text, ' ' ORDER BY turn) AS captions FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT number, ('0x' || substr(sha256('heldout:' || number), 1, 16))::UBIGINT % 10 <> 0 AND coalesce(captions, '') <> '' AS caption_applied,
  CASE WHEN ('0x' || substr(sha256('heldout:' || number), 1, 16))::UBIGINT % 10 <> 0 AND coalesce(captions, '') <> ''
  THEN regexp_replace(array_to_string(list_filter([substr(title, 1, 200), 'Image content: ' || substr(captions, 1, 400), substr(regexp_replace(body, '(?s)```.*?```', ' ', 'g'), 1, 1200)], lambda p: p <> ''), chr(10) || chr(10)), '^\s+|\s+$', '', 'g')
  ELSE substr(regexp_replace(title || chr(10) || chr(10) || regexp_replace(body, '(?s)```.*?```', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 1600) END AS embed_text FROM t LEFT JOIN a USING (number)""")
def captioned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a conversation stand in for image captions."""
    turns = T.table(spark, sf_dir, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    said = turns.groupBy(F.col("conv_id").alias("number")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("captions"))
    return tickets.recaption(tickets.derive(T.first_turns(spark, sf_dir)), said).select("number", "caption_applied", "embed_text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.texts(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("key").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("markdown"))


@register("text_blocks", r"""WITH l AS (SELECT 'doc-' || doc_id AS path, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
m AS (SELECT *, trim(line) = '' AS blank, regexp_matches(line, '^\s*\|') AS is_row FROM l),
s AS (SELECT *, NOT blank AND coalesce(lag(blank) OVER w OR (lag(is_row) OVER w <> is_row), true) AS starts FROM m WINDOW w AS (PARTITION BY path ORDER BY n)),
b AS (SELECT *, sum(starts::INT) OVER (PARTITION BY path ORDER BY n) AS block_no FROM s WHERE NOT blank)
SELECT path, count(DISTINCT block_no) AS n_blocks, sum(length(line))::BIGINT + count(*) - count(DISTINCT block_no) AS n_chars FROM b GROUP BY path""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents: the data holds neither fences nor headings, so a block is a run of lines of one kind."""
    pages = _pages(spark, sf_dir).select("path", F.col("markdown").alias("body"))
    return chunking.page_blocks(pages).groupBy("path").agg(F.count("*").alias("n_blocks"), F.sum(F.length("block")).alias("n_chars"))


@register("page_chunks")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks; tests compare the chunker with a line-by-line one."""
    return chunking.chunk_pages(_pages(spark, sf_dir)).select("path", "chunk_index", "section", "n_chars", F.md5("text").alias("text_md5"))


_IMAGES = " OR ".join(f"regexp_matches(coalesce(text, ''), {_re(p)})" for p in text.IMAGE_REFS)


@register("page_table", f"SELECT 'doc-' || doc_id AS path, 'doc-' || doc_id AS title, {_IMAGES} AS has_images, 'v1' AS corpus_version, coalesce(text, '') <> '' AS has_chunks FROM documents")
def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return chunking.page_table(pages, chunking.chunk_pages(pages), "v1").select("path", "title", "has_images", "corpus_version", (F.col("n_chunks") > 0).alias("has_chunks"))


@register("oversized_blocks", "WITH b AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS x FROM documents) SELECT doc_id, count(*) AS n FROM b WHERE length(x) > 2400 GROUP BY doc_id")
def oversized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n\n")).alias("text"))
    return chunking.oversized(rows).groupBy("doc_id").agg(F.count("*").alias("n"))


@register("json_lines", f"WITH {T.SQL_TICKETS} SELECT number, title, length(body) AS n_body FROM t")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets written as JSON lines and read back."""
    path = f"{_scratch(spark)}/tickets"
    files.write_json_lines(T.first_turns(spark, sf_dir), path, "number")
    return files.read_tickets(spark, path).select("number", "title", F.length("body").cast("bigint").alias("n_body"))


@register("corpus_reload", "SELECT vec_id AS key, label, list_sum(list_transform(embedding, lambda x: (x * 1000)::INT))::BIGINT AS total FROM embeddings")
def corpus_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as Parquet, loaded again and checked."""
    from tidemark.operators.checks import load_check

    rows = T.vectors(spark, sf_dir)
    rows.write.mode("overwrite").parquet(path := f"{_scratch(spark)}/vectors")
    load_check(rows, loaded := spark.read.parquet(path), "vec")
    total = F.aggregate(F.transform("vec", lambda x: F.rint(x * F.lit(1000).cast("float")).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return loaded.select("key", "label", total.alias("total"))


@register("sheet_round_trip", "SELECT doc_id, text AS note, source FROM documents")
def sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and quotes through a CSV sheet."""
    rows = T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("note"), "source")
    files.write_sheet(rows, path := f"{_scratch(spark)}/sheet")
    return files.read_sheet(spark, path, "doc_id bigint, note string, source string")
