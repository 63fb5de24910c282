"""Queries on classification, routing, drafts, logs and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import objects, scoring, stats
from tidemark.operators import evaluation, fusion
from tidemark.plans import tables as T
from tidemark.plans.registry import register
from tidemark.plans.retrieval import fused_vectors, SQL_FUSED
from tidemark.sources.shared import materialise

#: Term lists set to tokens of the test prose, which is invented.
COMPONENTS = {"sig/a": ("the", "and", "tion", "ing"), "sig/b": ("eau", "oi", "ment", "pour"), "sig/c": ("der", "sch", "heit", "ung", "keit")}
HIGH, MEDIUM = ("license", "rights"), ("que", "los")


def _sql_list(terms: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _found(name: str, terms: tuple[str, ...]) -> str:
    return f"list_filter({_sql_list(terms)}, lambda t: contains(x, t)) AS {name}"


SQL_TRIAGE = rf"""{T.SQL_TICKETS}, x AS (SELECT number, body, lower(title || chr(10) || body) AS x FROM t), f AS (SELECT number, length(body) AS body_chars, {', '.join(_found(f'f{i}', t) for i, t in enumerate(COMPONENTS.values()))},
  len(list_filter({_sql_list(HIGH)}, lambda t: contains(x, t))) > 0 AS high, len(list_filter({_sql_list(MEDIUM)}, lambda t: contains(x, t))) > 0 AS medium FROM x),
g AS (SELECT *, len(f0) + len(f1) + len(f2) AS total, CASE WHEN len(f2) >= len(f1) AND len(f2) >= len(f0) THEN 2 WHEN len(f1) >= len(f0) THEN 1 ELSE 0 END AS best FROM f),
h AS (SELECT *, CASE best WHEN 0 THEN list_sort(f0) WHEN 1 THEN list_sort(f1) ELSE list_sort(f2) END AS terms FROM g),
tr AS (SELECT number, body_chars, CASE WHEN len(terms) = 0 THEN 'unknown' WHEN best = 0 THEN 'sig/a' WHEN best = 1 THEN 'sig/b' ELSE 'sig/c' END AS component, CASE WHEN high THEN 'high' WHEN medium THEN 'medium' ELSE 'low' END AS severity,
  terms AS matched_terms, CASE WHEN len(terms) = 0 THEN 0.0 ELSE round(len(terms) / total * least(1.0, len(terms) / 3), 3) END AS confidence FROM h)"""


def _triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.first_turns(spark, sf_dir)
    return rows.withColumn("triage", scoring.triage(F.concat("title", F.lit("\n"), "body"), COMPONENTS, HIGH, MEDIUM)).withColumn("body_chars", F.length("body"))


@register("triage", f"WITH {SQL_TRIAGE} SELECT number, component, severity, matched_terms, confidence FROM tr")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triaged(spark, sf_dir).select("number", "triage.*")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _triaged(spark, sf_dir).withColumns({"retrieval": (F.col("number") % 11) / 10.0, "cited": F.col("number") % 7 != 0, "degraded": F.col("number") % 13 == 0, "sufficiency": F.when(F.col("number") % 3 != 0, (F.col("number") % 5 + 1).cast("int"))})
    return rows.withColumn("decision", scoring.route(F.col("triage.confidence"), F.col("retrieval"), F.col("cited"), F.col("body_chars"), F.col("degraded"), F.col("sufficiency")))


SQL_ROUTE = f"""{SQL_TRIAGE}, r AS (SELECT *, (number % 11) / 10.0 AS retrieval, number % 7 <> 0 AS cited, number % 13 = 0 AS degraded, CASE WHEN number % 3 <> 0 THEN number % 5 + 1 END AS sufficiency FROM tr),
s AS (SELECT *, round(CASE WHEN sufficiency IS NULL THEN 0.5 * confidence + 0.5 * retrieval ELSE 0.4 * confidence + 0.3 * retrieval + 0.3 * sufficiency / 5 END, 3) AS blend FROM r),
d AS (SELECT number, blend AS confidence, component, degraded, body_chars, CASE WHEN body_chars < 80 THEN 'request_info' WHEN degraded THEN 'escalate' WHEN sufficiency <= 2 THEN 'request_info' WHEN NOT cited THEN 'escalate' WHEN blend >= 0.65 THEN 'auto_attach' WHEN blend < 0.35 THEN 'request_info' ELSE 'escalate' END AS route FROM s)"""


@register("routing", f"WITH {SQL_ROUTE} SELECT number, route, confidence FROM d")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("number", "decision.route", "decision.confidence")


@register("route_distribution", f"WITH {SQL_ROUTE} SELECT route, component, count(*) AS n, avg(degraded::INT) AS degraded_share FROM d GROUP BY route, component")
def route_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _routed(spark, sf_dir)
    return rows.groupBy(F.col("decision.route").alias("route"), F.col("triage.component").alias("component")).agg(F.count("*").alias("n"), F.avg(F.col("degraded").cast("int")).alias("degraded_share"))


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, items): fused vectors with the documents of their ids as payload; odd ids are docs, even ids tickets."""
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", "source")
    items = fused_vectors(spark, sf_dir).join(docs, "key").select(
        "query_id", "position", F.when(F.col("key") % 2 == 1, "docs").otherwise("tickets").alias("corpus"), "key", F.substring("text", 1, 30).alias("title"), F.col("source").alias("context"), "text", F.concat(F.lit("/d/"), F.col("key").cast("string")).alias("url"),
    )
    asked = T.table(spark, sf_dir, "documents").where(F.col("doc_id") % T.QUERY_MOD == 0).select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"))
    return asked.join(T.vector_queries(T.vectors(spark, sf_dir)).select("query_id"), "query_id", "left_semi"), items


@register("drafts", rf"""WITH {SQL_FUSED}, i AS (SELECT p.query_id, p.position, p.key, CASE WHEN p.key % 2 = 1 THEN 'docs' ELSE 'tickets' END AS corpus, text, source FROM p JOIN documents ON doc_id = p.key WHERE position <= 8),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus ORDER BY position) AS n FROM i), k AS (SELECT * FROM n WHERE (corpus = 'docs' AND n <= 3) OR (corpus = 'tickets' AND n <= 2)),
a AS (SELECT query_id, max(CASE WHEN corpus = 'tickets' AND n = 1 THEN substr(text, 1, 30) END) AS tt, max(CASE WHEN corpus = 'tickets' AND n = 1 THEN '/d/' || key END) AS tu, max(CASE WHEN corpus = 'docs' AND n = 1 THEN substr(text, 1, 30) END) AS dt,
  string_agg(key::VARCHAR, ',' ORDER BY corpus, n) AS sources FROM k GROUP BY query_id)
SELECT doc_id AS query_id, CASE WHEN tt IS NOT NULL THEN 'A solved case looks alike: "' || trim(tt) || '" <' || tu || '>' WHEN dt IS NOT NULL THEN 'No solved case looks alike; the closest page is "' || dt || '"' ELSE 'Nothing was found' END AS probable_cause,
  coalesce(sources, '') AS sources, (NOT regexp_matches(substr(text, 1, 40) || ' ' || text, '\bv?\d+\.\d+'))::INT + (NOT contains(text, '```'))::INT + (length(text) < 200)::INT AS n_questions
FROM documents JOIN q ON q.query_id = doc_id LEFT JOIN a ON a.query_id = doc_id""")
def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fusion.drafts(*_items(spark, sf_dir))
    return made.select("query_id", "probable_cause", F.array_join(F.transform("citations", lambda c: c["source"]), ",").alias("sources"), F.size("clarifying_questions").alias("n_questions"))


@register("prompts", rf"""WITH {SQL_FUSED} SELECT p.query_id, md5(string_agg('[' || p.key || '] ' || substr(text, 1, 30) || chr(10) || substr(text, 1, 1600), chr(10) || chr(10) ORDER BY position)) AS prompt_md5 FROM p JOIN documents ON doc_id = p.key WHERE position <= 8 GROUP BY p.query_id""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.prompt(_items(spark, sf_dir)[1]).select("query_id", F.md5("prompt").alias("prompt_md5"))


@register("citation_cover", f"WITH {SQL_FUSED}, c AS (SELECT query_id, key + CASE WHEN position % 4 = 0 THEN 1000000 ELSE 0 END AS source FROM p WHERE position <= 8) SELECT (SELECT count(*) FROM c JOIN (SELECT * FROM p WHERE position <= 8) r ON r.query_id = c.query_id AND r.key = c.source) AS n_cited, (SELECT count(*) FROM c WHERE source >= 1000000) AS n_uncovered")
def citation_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of fused keys, every fourth outside the context: a semi-join and an anti-join."""
    items = materialise(fused_vectors(spark, sf_dir), "fused")
    cites = items.select("query_id", (F.col("key") + F.when(F.col("position") % 4 == 0, 1000000).otherwise(0)).alias("source"))
    n = fusion.cited(items, cites).agg(F.count("*").alias("n_cited")).withColumn("one", F.lit(1))
    m = fusion.uncovered(cites.withColumn("source", F.col("source").cast("string")), items).agg(F.count("*").alias("n_uncovered")).withColumn("one", F.lit(1))
    return n.join(m, "one").drop("one")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: the value is the latency, the type the route, the status follows from the id."""
    rows = T.table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 17 == 0, 503).when(F.col("event_id") % 19 == 0, 404).when(F.col("event_id") % 23 == 0, 0).otherwise(200)
    return rows.select("event_id", "ts", F.col("value").alias("duration_ms"), status.alias("status"), F.lit(None).cast("string").alias("error"), (F.col("event_type") == "error").alias("degraded"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise("escalate").alias("route"), F.col("user_id").alias("input_tokens"), F.floor("value").cast("bigint").alias("output_tokens"))


SQL_LOG = """l AS (SELECT event_id, ts, value AS duration_ms, CASE WHEN event_id % 17 = 0 THEN 503 WHEN event_id % 19 = 0 THEN 404 WHEN event_id % 23 = 0 THEN 0 ELSE 200 END AS status, event_type = 'error' AS degraded, CASE WHEN event_id % 5 = 0 THEN event_type ELSE 'escalate' END AS route, user_id AS input_tokens, floor(value)::BIGINT AS output_tokens FROM events),
c AS (SELECT *, CASE WHEN status = 0 THEN 'transport_error' WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'client_error' WHEN degraded THEN 'degraded_ok' ELSE 'llm_ok' END AS class FROM l)"""


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).withColumn("class", scoring.outcome(F.col("status"), F.col("error"), F.col("degraded")))


@register("outcome_latency", f"WITH {SQL_LOG} SELECT class, count(*) AS n, round(quantile_cont(duration_ms, 0.5), 6) AS p50, CASE WHEN count(*) >= 20 THEN round(quantile_cont(duration_ms, 0.95), 6) END AS p95, CASE WHEN count(*) >= 100 THEN round(quantile_cont(duration_ms, 0.99), 6) END AS p99, round(max(duration_ms), 6) AS max FROM c GROUP BY class")
def outcome_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.report_percentiles(_classed(spark, sf_dir), "duration_ms", "class")
    return rows.select("class", "n", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99", "max")))


@register("protocol_checks", f"WITH {SQL_LOG} SELECT count_if(status = 200) AS n_status_ok, count_if(route IN ('auto_attach', 'escalate', 'request_info')) AS n_route_ok, count_if(degraded = false) AS n_arm_ok, count(*) AS n FROM l")
def protocol_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).select(scoring.protocol_checks(F.col("status"), F.col("route"), F.col("degraded"), F.lit(False)).alias("c")).select("c.*")
    return rows.agg(F.count_if("status_ok").alias("n_status_ok"), F.count_if("route_ok").alias("n_route_ok"), F.count_if("arm_ok").alias("n_arm_ok"), F.count("*").alias("n"))


@register("token_costs", "SELECT event_type AS run, count(*) AS calls, sum(user_id)::BIGINT AS input_tokens, sum(floor(value)::BIGINT)::BIGINT AS output_tokens, round(sum(user_id) * 1e-6 + sum(floor(value)::BIGINT) * 5e-6, 4) AS cost FROM events GROUP BY event_type")
def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("user_id").alias("input_tokens"), F.floor("value").cast("bigint").alias("output_tokens"))
    return evaluation.cost(rows, "run")


@register("score_validation", """WITH e AS (SELECT event_id, user_id % 7 AS a, event_id % 6 AS b FROM events) SELECT event_id, CASE WHEN a BETWEEN 1 AND 5 AND b <> 4 THEN CASE WHEN b = 3 THEN NULL ELSE a END WHEN b = 4 OR b = 3 THEN NULL ELSE a END::INT AS groundedness, NOT (a BETWEEN 1 AND 5) OR b IN (3, 4) AS failed FROM e""")
def score_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output made from events: every sixth score is a text, every sixth a boolean."""
    value = F.when(F.col("event_id") % 6 == 4, F.lit('"4"')).when(F.col("event_id") % 6 == 3, F.lit("true")).otherwise((F.col("user_id") % 7).cast("string"))
    rows = T.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"groundedness": '), value, F.lit("}")).alias("json"))
    checked = rows.select("event_id", scoring.valid_scores(F.col("json"), ["groundedness"]).alias("v"))
    return checked.select("event_id", "v.groundedness", F.col("v.error").isNotNull().alias("failed"))


@register("first_objects", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS object FROM events""")
def first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties inside prose: fenced, after an empty object, and cut."""
    n = F.col("event_id") % 3
    said = F.when(n == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(n == 1, F.concat(F.lit("{} and {x "), "props", F.lit(" }"))).otherwise(F.regexp_replace("props", "[}]", ""))
    return T.table(spark, sf_dir, "events").select("event_id", objects.first_object(said).alias("object"))


@register("triage_accuracy", f"WITH {SQL_TRIAGE} SELECT severity, count(*) AS n, count_if(component = 'sig/c') AS n_correct, count_if(component = 'sig/c') / count(*) AS accuracy FROM tr GROUP BY severity")
def triage_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _triaged(spark, sf_dir).select("triage.component", "triage.severity")
    return evaluation.accuracy(rows, F.col("component") == "sig/c", "severity")
