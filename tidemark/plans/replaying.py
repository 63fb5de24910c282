"""Queries on change replay and data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import checks, replay, tickets, versions
from tidemark.plans import tables as T
from tidemark.plans.registry import register
from tidemark.sources.shared import table_path

CURRENT = "SELECT path, arg_max(seq, (seq, op_no)) AS seq, arg_max(n_chunks, (seq, op_no)) AS n_chunks, arg_max(live, (seq, op_no)) AS live FROM o {where} GROUP BY path"


@register("replay_current", f"WITH {T.SQL_CHANGES} SELECT path, seq, n_chunks FROM ({CURRENT.format(where='')}) WHERE live")
def replay_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.view(T.changes(spark, sf_dir)).select("path", "seq", "n_chunks")


@register("replay_as_of", f"WITH {T.SQL_CHANGES} SELECT path, seq, n_chunks FROM ({CURRENT.format(where='WHERE seq <= 500')}) WHERE live")
def replay_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as it stood after change 500."""
    return replay.view(T.changes(spark, sf_dir), as_of=500).select("path", "seq", "n_chunks")


def _versions(spark: SparkSession, sf_dir: str) -> versions.Versions:
    """All changes as versions, the last third appended later, in layers of 300."""
    changes, kept = T.changes(spark, sf_dir), versions.Versions(spark, table_path(spark, "versions"))
    last = changes.agg(F.max("seq")).first()[0] or 0
    return kept.append(changes.where(F.col("seq") * 3 <= 2 * last), step=max(300, last // 6)).append(changes, step=max(300, last // 6))


@register("versions_as_of", f"WITH {T.SQL_CHANGES} SELECT path, seq, n_chunks, payload FROM (SELECT path, arg_max(seq, (seq, op_no)) AS seq, arg_max(n_chunks, (seq, op_no)) AS n_chunks, arg_max(payload, (seq, op_no)) AS payload, arg_max(live, (seq, op_no)) AS live FROM o WHERE seq <= 500 GROUP BY path) WHERE live")
def versions_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after change 500, read from one layer of kept versions."""
    return _versions(spark, sf_dir).as_of(500)


@register("versions_compacted", f"WITH {T.SQL_CHANGES} SELECT path, seq, n_chunks FROM ({CURRENT.format(where='')}) WHERE live")
def versions_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after all changes, from one layer that all were put into."""
    kept = _versions(spark, sf_dir)
    layers = kept.layers()
    return kept.compact(layers[0][0], layers[-1][1]).as_of(layers[-1][1] - 1).select("path", "seq", "n_chunks")


@register("replay_ledger", f"""WITH {T.SQL_CHANGES}, b AS (SELECT *, coalesce(lag(n_chunks) OVER (PARTITION BY path ORDER BY seq, op_no), 0) AS before FROM o),
g AS (SELECT seq, arg_min(before, op_no) AS chunks_before, arg_max(n_chunks, op_no) AS chunks_after FROM b GROUP BY seq) SELECT c.seq, c.path, change_type, old_path, chunks_before, chunks_after FROM c JOIN g USING (seq)""")
def replay_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.ledger(T.changes(spark, sf_dir))


@register("replay_pending", f"WITH {T.SQL_CHANGES} SELECT seq, change_type, path FROM c WHERE seq > 100 ORDER BY seq LIMIT 25")
def replay_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 25 changes after the high-water mark 100: the number of changes taken at a time is the feature."""
    return replay.pending(T.changes(spark, sf_dir), 100, 25).select("seq", "change_type", "path")


@register("scripted_delete", f"WITH {T.SQL_CHANGES} SELECT count(*) AS n_pages, count_if(path = '7') AS n_target FROM ({CURRENT.format(where='')}) WHERE live AND path <> '7'")
def scripted_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = replay.view(replay.scripted_delete(T.changes(spark, sf_dir), "7"))
    return after.agg(F.count("*").alias("n_pages"), F.count_if(F.col("path") == "7").alias("n_target"))


@register("change_lines", """SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN CASE WHEN user_id % 3 = 0 THEN 'deleted' ELSE 'renamed' END ELSE 'modified' END AS change_type,
  CASE WHEN event_type = 'purchase' AND user_id % 3 <> 0 THEN 'docs/' || (user_id + 1000) || '.md' ELSE 'docs/' || user_id || '.md' END AS path, CASE WHEN event_type = 'purchase' AND user_id % 3 <> 0 THEN 'docs/' || user_id || '.md' END AS old_path
  FROM events WHERE user_id % 5 <> 0""")
def change_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as status lines: every third rename leaves the subtree, every fifth file is no page."""
    code = F.create_map(*(F.lit(x) for p in {"signup": "A", "view": "M", "click": "M", "error": "D"}.items() for x in p))[F.col("event_type")]
    file = F.concat(F.lit("docs/"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 5 == 0, ".txt").otherwise(".md"))
    to = F.concat(F.when(F.col("user_id") % 3 == 0, "blog/").otherwise("docs/"), (F.col("user_id") + 1000).cast("string"), F.when(F.col("user_id") % 5 == 0, ".txt").otherwise(".md"))
    line = F.when(F.col("event_type") == "purchase", F.concat_ws("\t", F.lit("R100"), file, to)).otherwise(F.concat_ws("\t", code, file))
    return replay.classify(T.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), line.alias("line")), "docs/")


@register("repeated_texts", "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.repeated_keys(T.table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5")), "text_md5")


@register("first_copies", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1")
def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    return tickets.first_seen(rows, "h", "source", "doc_id").select("doc_id", "source")


@register("order_checks", """SELECT 'orders without customer' AS problem, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lines without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'repeated lines', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'status outside', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = T.table(spark, sf_dir, "orders"), T.table(spark, sf_dir, "lineitem")
    found = {
        "orders without customer": checks.without_parent(orders, T.table(spark, sf_dir, "customer"), "o_custkey", "c_custkey"), "lines without order": checks.without_parent(lines, orders, "l_orderkey", "o_orderkey"),
        "repeated lines": checks.repeated_keys(lines, "l_orderkey", "l_linenumber"), "status outside": checks.outside(orders, "o_orderstatus", ["O", "F"]),
    }
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n") for name, df in found.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@register("missing_values", "SELECT 'text' AS column, count(*) AS n FROM documents WHERE text IS NULL HAVING count(*) > 0 UNION ALL SELECT 'source', count(*) FROM documents WHERE source IS NULL HAVING count(*) > 0")
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing(T.table(spark, sf_dir, "documents"), "text", "source")


@register("artifact_checks", """WITH a AS (SELECT 'run' || event_id AS name, event_id % 50 AS m, (props->>'k')::INT AS k FROM events) SELECT name, 'lacks k' AS problem FROM a WHERE m = 0 UNION ALL SELECT name, 'dirty tree' FROM a WHERE m = 1 UNION ALL SELECT name, 'no JSON' FROM a WHERE m = 2""")
def artifact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as artifacts: some lose their field, some are dirty, some are cut."""
    m = F.col("event_id") % 50
    body = F.when(m == 0, F.lit('{"j": 1}')).when(m == 1, F.regexp_replace("props", r"\}$", ', "dirty": true}')).when(m == 2, F.lit('{"k": ')).otherwise(F.col("props"))
    rows = T.table(spark, sf_dir, "events").select(F.concat(F.lit("run"), F.col("event_id").cast("string")).alias("name"), body.alias("body"))
    return checks.artifact_problems(rows, {"run": ["k"]})
