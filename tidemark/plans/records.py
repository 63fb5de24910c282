"""Queries on ticket records, side tables, checked model output, markdown and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import hashing, scoring, text
from tidemark.operators import checks, chunking, evaluation, fusion, replay, tickets
from tidemark.plans import tables as T
from tidemark.plans.registry import register
from tidemark.plans.serving import _items
from tidemark.plans.retrieval import SQL_FUSED
from tidemark.plans.text_prep import _scratch
from tidemark.sources import files

_HELD = "('0x' || substr(sha256('heldout:' || doc_id), 1, 16))::UBIGINT % 10 = 0"


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tickets: number, source, is_held_out."""
    n = F.col("doc_id")
    return T.table(spark, sf_dir, "documents").select(n.alias("number"), "source", hashing.is_held_out(n).alias("is_held_out"))


@register("ticket_shapes", """WITH n AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS merged, arg_min(l_partkey, (l_linenumber, l_partkey)) FILTER (l_linestatus = 'O') AS ours FROM lineitem GROUP BY 1)
SELECT o_orderkey AS number, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END AS body, o_orderpriority || ',sig/' || o_orderstatus AS labels, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'sig/' || o_orderstatus ELSE '' END AS sigs, o_orderdate::DATE AS created, coalesce(merged, ours) AS closing_pr_number
FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""")
def ticket_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issue records, their lines as closing requests of two repositories."""
    repository = F.struct(F.when(F.col("l_linestatus") == "O", "up/stream").otherwise("a/fork").alias("nameWithOwner"))
    node = F.struct("l_linenumber", F.col("l_partkey").alias("number"), F.concat(F.lit("/r/"), F.col("l_partkey")).alias("url"), (F.col("l_returnflag") == "N").alias("merged"), repository.alias("repository"))
    nodes = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(node)).alias("closing_nodes"))
    raw = T.table(spark, sf_dir, "orders").join(nodes, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").alias("number"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("body"),
        F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.concat(F.lit("sig/"), "o_orderstatus").alias("name"))).alias("labels"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.lit(None).cast("string").alias("closed_at"), F.lit("/").alias("url"), "closing_nodes",
    )
    shaped = tickets.shape(raw, ["sig/F", "sig/O"], "up/stream")
    return shaped.select("number", "body", F.array_join("labels", ",").alias("labels"), F.array_join("sigs", ",").alias("sigs"), F.to_date("created_at").alias("created"), "closing_pr_number")


@register("ticket_vectors", f"SELECT doc_id AS number, {_HELD} AS is_held_out, CASE WHEN NOT {_HELD} THEN len(embedding)::INT END AS dims FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def ticket_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors attached to the tickets that may be found, written and loaded with their nulls."""
    vectors = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("number"), "embedding")
    files.write_corpus(tickets.attach_vectors(_held(spark, sf_dir), vectors), vectors, folder := _scratch(spark))
    loaded, side = files.read_corpus(spark, folder)
    checks.load_check(vectors, side, "embedding")
    return loaded.select("number", "is_held_out", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))


@register("newest_held_out", f"SELECT doc_id AS number, source FROM documents WHERE {_HELD} ORDER BY doc_id DESC LIMIT 20")
def newest_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation set of the 20 newest held-out tickets: its size is the feature."""
    return tickets.newest(_held(spark, sf_dir), 20).select("number", "source")


@register("held_out_floor", f"SELECT count(*) AS n_held_out FROM documents WHERE {_HELD}")
def held_out_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(checks.held_out_floor(_held(spark, sf_dir))).cast("bigint").alias("n_held_out"))


@register("health_gate", "SELECT count_if(event_type = 'error') AS n_degraded FROM events")
def health_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with no more degraded rows than there are rows of other kinds passes."""
    rows = T.table(spark, sf_dir, "events")
    n = evaluation.health_gate(rows, F.col("event_type") == "error", rows.where("event_type <> 'error'").count())
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n_degraded"))


@register("incoming_valid", "WITH d AS (SELECT doc_id, doc_id % 60 - 5 AS t, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE source END AS title FROM documents) SELECT doc_id, coalesce(t BETWEEN 0 AND 49 AND trim(title) <> '', false) AS valid FROM d")
def incoming_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 60 - 5).alias("tenant_id"), F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("source")).alias("title"))
    valid, rejected = tickets.split_valid(rows)
    return valid.select("doc_id", F.lit(True).alias("valid")).union(rejected.select("doc_id", F.lit(False)))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a cache of closing requests (number, title, body): a JSON object for each nation, every fourth entry without a title."""
    entry = F.struct(F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("title"), F.col("c_mktsegment").alias("body"))
    objects = T.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), entry)))).alias("value"))
    objects.write.partitionBy("c_nationkey").text(path := _scratch(spark))
    return files.read_cache(spark, path, "title:string,body:string").select(F.col("key").cast("bigint").alias("number"), "title", "body")


@register("json_cache", "SELECT c_custkey AS number, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS title, c_mktsegment AS body FROM customer")
def json_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir)


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("closing_pr_number"), F.col("o_orderpriority").alias("closing_pr_title"))


@register("hydrated_requests", "SELECT o_orderkey AS number, CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE o_orderpriority END AS title, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS body FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def hydrated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets.hydrate(_closed(spark, sf_dir), _cache(spark, sf_dir))
    return rows.select("number", F.col("closing_pr_title").alias("title"), F.col("closing_pr_body").alias("body"))


@register("requests_to_fetch", "SELECT DISTINCT o_custkey AS number FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)")
def requests_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = T.table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("number"))
    return tickets.not_cached(_closed(spark, sf_dir), cache)


@register("filled_sheet", """WITH s AS (SELECT DISTINCT conv_id AS n FROM conversations), r AS (SELECT n, CASE WHEN n % 3 <> 0 THEN n % 2 = 0 END AS d, CASE WHEN n % 5 <> 0 THEN (n % 4)::INT END AS score FROM s)
SELECT n AS ticket_number, coalesce(d::VARCHAR, '') AS degraded, CASE WHEN d IS NULL THEN '' ELSE 'escalate' END AS route, CASE WHEN NOT coalesce(d, false) THEN coalesce(score, 9) END AS judge_tone FROM r""")
def filled_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of all conversations, filled from a run over some of them and scores of others."""
    n = F.col("ticket_number")
    sheet = T.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ticket_number")).distinct().withColumns({"degraded": F.lit(""), "route": F.lit(""), "judge_tone": F.lit(9)})
    outcomes = sheet.where(n % 3 != 0).select(n, (n % 2 == 0).alias("degraded"), F.lit("escalate").alias("route"))
    return tickets.fill_sheet(sheet, outcomes, sheet.where(n % 5 != 0).select(n, (n % 4).cast("int").alias("judge_tone")), ["judge_tone"])


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose address is matched with the directories of their language, those of every seventh document."""
    docs = T.table(spark, sf_dir, "documents")
    folder = F.concat(F.lit("/"), "source", F.lit("/"))
    directories = docs.where("doc_id % 7 = 0").groupBy(F.col("lang").alias("sig")).agg(F.collect_set(folder).alias("dirs"))
    return tickets.directory_match(docs.select("doc_id", "lang", F.array("lang").alias("sigs"), F.concat(F.lit("/docs"), folder, "doc_id").alias("url")), directories, "doc_id")


SQL_DOMAINS = "dm AS (SELECT doc_id, lang, EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 7 = 0 AND b.lang = a.lang AND b.source = a.source) AS in_domain FROM documents a)"


@register("directory_hits", f"WITH {SQL_DOMAINS} SELECT doc_id, in_domain FROM dm")
def directory_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domains(spark, sf_dir).select("doc_id", "in_domain")


@register("domain_accuracy", f"WITH {SQL_DOMAINS} SELECT lang, count(*) AS n, count_if(in_domain) AS n_correct, count_if(in_domain) / count(*) AS accuracy FROM dm GROUP BY lang")
def domain_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(_domains(spark, sf_dir), F.col("in_domain"), "lang")


def _illustrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets that show a picture of their own, one of their source's number and the first once more."""
    n = F.col("doc_id")
    own, shared = F.concat(F.lit("https://x.org/"), n, F.lit(".png")), F.concat(F.lit("https://x.org/"), n % 10, F.lit(".png"))
    return T.table(spark, sf_dir, "documents").select(n.alias("number"), "source", F.concat(F.lit("see ![a]("), own, F.lit(') and <img src="'), shared, F.lit('"> ![again]('), own, F.lit(")")).alias("body"))


#: Ways to show or name a picture, each with what must be found in it; # stands for the number.
_SHOWN = (
    ("![own](https://x.org/#.png) and ![own](https://x.org/#.png)", "https://x.org/#.png"), ("![open](https://x.org/#/open.png and ![titled](https://x.org/#/titled.png 'a')", None), ("<IMG alt='x' SRC='https://x.org/#/upper.png'>", "https://x.org/#/upper.png"),
    ("<img alt=none data-src=\"x\" src=\"http://x.org/#/tag.png\">", "http://x.org/#/tag.png"), ("[see https://github.com/user-attachments/assets/#]", "https://github.com/user-attachments/assets/#"),
    ("https://github.com/user-attachments/files/#/log.txt", None), ("https://user-images.githubusercontent.com/#/bare.png<br>", "https://user-images.githubusercontent.com/#/bare.png"), ("![no address](img/#.png)", None),
)
#: Markdown images come first, then tags, then bare addresses, each in order of the text, which is that of falling bits; three at most.
_URL_ORDER = (0, 3, 2, 6, 4)


@register("image_urls", "SELECT doc_id AS number, list_slice(list_filter([" + ", ".join(f"""CASE WHEN (doc_id >> {i}) & 1 = 1 THEN replace('{_SHOWN[i][1]}', '#', doc_id::VARCHAR) END""" for i in _URL_ORDER) + "], lambda u: u IS NOT NULL), 1, 3) AS urls FROM documents")
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets that show pictures in the ways that the bits of their number name."""
    n = F.col("doc_id")
    shown = [F.when(F.shiftright(n, i).bitwiseAND(F.lit(1)) == 1, F.replace(F.lit(said), F.lit("#"), n.cast("string"))) for i, (said, _) in reversed(list(enumerate(_SHOWN)))]
    return T.table(spark, sf_dir, "documents").select(n.alias("number"), text.image_urls(F.concat_ws("\n", *shown)).alias("urls"))


@register("image_captions", """WITH u AS (SELECT doc_id AS number, 1 AS i, doc_id AS pic FROM documents UNION ALL SELECT doc_id, 2, doc_id % 10 FROM documents WHERE doc_id >= 10), c AS (SELECT doc_id AS pic, source AS caption FROM documents WHERE doc_id % 2 = 0)
SELECT number, string_agg(caption, ' ' ORDER BY i) AS captions FROM u JOIN c USING (pic) WHERE caption IS NOT NULL GROUP BY number""")
def image_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions by image address; pictures with even numbers have one."""
    rows = _illustrated(spark, sf_dir)
    cache = rows.select(F.concat(F.lit("https://x.org/"), "number", F.lit(".png")).alias("url"), F.when(F.col("number") % 2 == 0, F.col("source")).alias("caption"))
    return tickets.captions(rows, cache)


_MARKDOWN = (
    '---\ntitle: "T', "doc_id", '"\ndraft: false\n---\nIntro {{< glossary_tooltip text="', "source", '" term_id="x" >}} of\n{{< note >}}', "lang", "{{< /note >}}.\n\n## Head ", "lang", "\nPara ", "doc_id",
    " <!-- gone\naway --> stays\n\n```yaml\n## not a heading {{< kept >}}\n\n| x |\n```\n### Deep\n| a | b |\n| ", "doc_id", " | 2 |\nAfter ", "n_chars", "\n\n# Next\nlast",
)
_PARTS = (
    ("''", """'Intro ' || source || ' of' || chr(10) || lang || '.'"""),
    ("'Head ' || lang", """'Para ' || doc_id || '  stays' || chr(10) || chr(10) || '```yaml' || chr(10) || '## not a heading {{< kept >}}' || chr(10) || chr(10) || '| x |' || chr(10) || '```'"""),
    ("'Head ' || lang || ' / Deep'", """'| a | b |' || chr(10) || '| ' || doc_id || ' | 2 |' || chr(10) || chr(10) || 'After ' || n_chars"""),
    ("'Next'", "'last'"),
)


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' columns as pages with front matter, tags, a fence, headings and a table."""
    parts = [F.col(x).cast("string") if x in ("doc_id", "source", "lang", "n_chars") else F.lit(x) for x in _MARKDOWN]
    return T.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("path"), F.concat(*parts).alias("markdown"))


@register("page_chunks_markdown", " UNION ALL ".join(f"SELECT 'doc-' || doc_id AS path, 'T' || doc_id AS title, {i}::INT AS chunk_index, {s} AS section, 'T' || doc_id || CASE WHEN {s} = '' THEN '' ELSE ' / ' || {s} END || chr(10) || chr(10) || {b} AS text FROM documents" for i, (s, b) in enumerate(_PARTS)))
def page_chunks_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_pages(_markdown(spark, sf_dir)).select("path", "title", "chunk_index", "section", "text")


@register("corpus_tables", "SELECT 'doc-' || doc_id AS path, 'T' || doc_id AS title, 4 AS n_chunks, 4::BIGINT AS n_loaded, 'v2' AS corpus_version FROM documents")
def corpus_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and chunks written as the two tables of a corpus, and loaded."""
    raw = _markdown(spark, sf_dir)
    chunks = chunking.chunk_pages(raw)
    files.write_corpus(chunking.page_table(raw, chunks, "v2"), chunks, folder := _scratch(spark))
    pages, loaded = files.read_corpus(spark, folder)
    return pages.join(loaded.groupBy("path").agg(F.count("*").alias("n_loaded")), "path").select("path", "title", "n_chunks", "n_loaded", "corpus_version")


@register("artifact_files", "SELECT n_name AS nation, n_regionkey::INT AS region FROM nation")
def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file for each nation, read back as artifacts of any shape."""
    T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run"), "n_name", "n_regionkey").write.partitionBy("run").json(folder := _scratch(spark))
    body = F.try_parse_json("body")
    return files.read_artifacts(spark, folder).select(F.try_variant_get(body, "$.n_name", "string").alias("nation"), F.try_variant_get(body, "$.n_regionkey", "int").alias("region"))


@register("change_feed", "SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type, 'docs/' || user_id || '.md' AS path FROM events")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as numbered lines of a feed, written as text and classified after reading."""
    code = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "error", "D").otherwise("M")
    line = F.concat_ws("\t", F.col("event_id").cast("string"), code, F.concat(F.lit("docs/"), "user_id", F.lit(".md")))
    T.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path := _scratch(spark))
    return replay.classify(files.read_changes(spark, path), "docs/").select("seq", "change_type", "path")


@register("draft_dump", f"""WITH {SQL_FUSED}, i AS (SELECT p.query_id, p.position, p.key, CASE WHEN p.key % 2 = 1 THEN 0 ELSE 1 END AS o FROM p JOIN documents ON doc_id = p.key WHERE position <= 8),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, o ORDER BY position) AS n FROM i), a AS (SELECT query_id, string_agg('/d/' || key, ' ' ORDER BY o, n) AS urls FROM n WHERE n <= 3 - o GROUP BY query_id)
SELECT doc_id AS query_id, coalesce(urls, '') AS urls FROM documents JOIN q ON q.query_id = doc_id LEFT JOIN a ON a.query_id = doc_id""")
def draft_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts dumped as JSON lines in order of their query, and read back."""
    files.write_json_lines(fusion.drafts(*_items(spark, sf_dir)), path := _scratch(spark), "query_id")
    return files.read_drafts(spark, path).select("query_id", F.array_join(F.transform("citations", lambda c: c["url"]), " ").alias("urls"))


@register("corpus_reset", """WITH r AS (SELECT md5(doc_id || '|' || md5(coalesce(text, ''))) AS h FROM documents), s AS (SELECT count(*) AS n_rows, sum(('0x' || substr(h, 1, 7))::BIGINT)::BIGINT AS a, sum(('0x' || substr(h, 8, 7))::BIGINT)::BIGINT AS b FROM r)
SELECT n_rows, substr(md5(n_rows || '|' || a || '|' || b), 1, 12) AS fingerprint, 0 AS n_ledger FROM s""")
def corpus_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus that lost pages, reset to its base snapshot and verified."""
    base = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    recorded = hashing.check_fingerprint(base, "doc_id", "text", None)
    base.where("doc_id % 3 <> 0").write.parquet(f"{(folder := _scratch(spark))}/pages")
    pages = files.reset_corpus(base, folder, "doc_id", "text", recorded)
    left = spark.read.schema(files.LEDGER).parquet(f"{folder}/ledger").count()
    return hashing.fingerprint(pages, "doc_id", "text").withColumn("n_ledger", F.lit(left).cast("int"))


@register("checked_triage", """WITH e AS (SELECT event_id, event_id % 4 AS c, event_id % 9 AS n, event_id % 15 AS k, event_id % 7 AS s FROM events)
SELECT event_id, CASE c WHEN 3 THEN NULL ELSE 'sig/' || c END AS component, CASE WHEN c = 3 THEN 'low' WHEN s = 0 THEN 'low' WHEN s < 4 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN c = 3 OR n = 8 THEN 0 ELSE least(6, n) END::INT AS n_terms,
  CASE WHEN c = 3 OR k IN (0, 1, 2) THEN 0.0 ELSE least(1.0, k / 10.0) END::DOUBLE AS confidence, c >= 2 OR n = 8 OR k IN (1, 2) AS failed FROM e""")
def checked_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a classifier made from events: cut off, with an unknown component, evidence that is no list, a confidence that is missing, a word, null or a number in quotes, a severity that is missing."""
    e = F.col("event_id")
    terms = F.when(e % 9 == 8, "7").otherwise(F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('"t"'), (e % 9).cast("int")), ","), F.lit("]")))
    number = F.format_string("%.1f", (e % 15) / 10.0)
    confidence = F.when(e % 15 == 0, "").when(e % 15 == 1, ', "confidence": "sure"').when(e % 15 == 2, ', "confidence": null').when(e % 15 == 3, F.concat(F.lit(', "confidence": "'), number, F.lit('"'))).otherwise(F.concat(F.lit(', "confidence": '), number))
    severity = F.when(e % 7 == 0, "").when(e % 7 < 4, ', "severity": "high"').otherwise(', "severity": "medium"')
    said = F.concat(F.lit('{"component": "sig/'), e % 4, F.lit('", "matched_terms": ["not", "these"], "evidence": '), terms, confidence, severity, F.when(e % 4 == 3, "").otherwise("}"))
    v = scoring.valid_triage(said, ["sig/0", "sig/1"])
    return T.table(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", "v.component", "v.severity", F.size("v.terms").alias("n_terms"), "v.confidence", F.col("v.error").isNotNull().alias("failed"))


SQL_CHECKED = """e AS (SELECT event_id, user_id % 7 AS s, event_id % 3 <> 0 AS cites, event_id % 4 AS k FROM events),
cd AS (SELECT event_id, s::INT AS sufficiency, CASE WHEN cites THEN 1 ELSE 0 END AS n_citations, CASE WHEN s NOT BETWEEN 1 AND 5 THEN 'bad sufficiency' WHEN cites AND k = 3 THEN 'citation outside the context' WHEN NOT cites AND s > 2 THEN 'uncited' WHEN event_id % 10 IN (1, 2, 3) THEN 'no cause or fix' END AS error, CASE WHEN event_id % 10 NOT IN (1, 2) THEN 'c' || event_id END AS probable_cause, CASE WHEN event_id % 10 <> 3 THEN 'f' END AS suggested_fix FROM e)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, said, v): drafted answers made from events, checked against three keys."""
    e = F.col("event_id")
    cites = F.when(e % 3 != 0, F.concat(F.lit('[{"source": "k'), e % 4, F.lit('", "quote": " q "}]'))).otherwise("[]")
    cause = F.when(e % 10 == 1, "").when(e % 10 == 2, ', "probable_cause": ""').otherwise(F.concat(F.lit(', "probable_cause": "c'), e, F.lit('"')))
    fix = F.when(e % 10 == 3, ', "suggested_fix": null').otherwise(', "suggested_fix": "f"')
    said = F.concat(F.lit('{"context_sufficiency": '), F.col("user_id") % 7, F.lit(', "citations": '), cites, cause, fix, F.lit(', "clarifying_questions": ["a", "b", "c", "d"]}'))
    return T.table(spark, sf_dir, "events").select("*", said.alias("said")).withColumn("v", scoring.valid_draft(F.col("said"), F.array(*(F.lit(f"k{i}") for i in range(3)))))


@register("checked_drafts", f"WITH {SQL_CHECKED} SELECT event_id, sufficiency, probable_cause, suggested_fix, n_citations::INT AS n_citations, 3 AS n_questions, error FROM cd")
def checked_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("event_id", "v.sufficiency", "v.probable_cause", "v.suggested_fix", F.size("v.citations").alias("n_citations"), F.size("v.questions").alias("n_questions"), "v.error")


@register("degrade_latches", f"""WITH {SQL_CHECKED}, r AS (SELECT event_id, error, event_id % 5 = 0 AS triage, user_id % 11 = 0 AS retrieval FROM cd JOIN events USING (event_id))
SELECT event_id, triage OR retrieval OR error IS NOT NULL AS degraded, concat_ws(',', CASE WHEN triage THEN 'triage' END, CASE WHEN retrieval THEN 'retrieval' END, CASE WHEN error IS NOT NULL THEN 'draft' END) AS stages,
  CASE WHEN error IS NULL THEN 'model' ELSE 'extractive' END AS source, CASE WHEN error IS NOT NULL THEN 'escalate' ELSE 'auto_attach' END AS route FROM r""")
def degrade_latches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages fail independently; the draft falls back to the extractive one, and only its flag reaches the route."""
    failed = F.col("v.error").isNotNull()
    flags = scoring.degraded({"triage": F.col("event_id") % 5 == 0, "retrieval": F.col("user_id") % 11 == 0, "draft": failed})
    draft = scoring.served_draft(F.col("v"), F.col("said"), F.concat(F.lit("see "), "event_type"))
    to = scoring.route(F.lit(0.9), F.lit(0.9), F.lit(True), F.lit(500), failed, F.lit(None).cast("int"))
    rows = _answers(spark, sf_dir).select("event_id", flags.alias("f"), draft.alias("d"), to.alias("to"))
    return rows.select("event_id", "f.degraded", F.array_join("f.stages", ",").alias("stages"), "d.source", "to.route")
