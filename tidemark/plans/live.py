"""Queries on streams: telemetry windows and the change feed, run to the end of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import scoring
from tidemark.plans import tables as T
from tidemark.plans.registry import register
from tidemark.plans.serving import COMPONENTS, HIGH, MEDIUM, SQL_TRIAGE
from tidemark.plans.text_prep import _scratch
from tidemark.streaming import closing, feed, telemetry


def _closed(rows: DataFrame, measure: closing.Measure, length: str, slide: str | None = None, steps: bool = False) -> str:
    """The folder in which ``rows`` (with their arrival, 0 to 2) have been followed as a stream, batch after batch, and the windows that closed are. steps: windows are closed after each batch, not only at the end."""
    spark, folder = rows.sparkSession, _scratch(rows.sparkSession)
    arriving = rows.drop("arrival")
    for k in range(3):
        rows.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{folder}/in")
        closing.follow(spark.readStream.schema(arriving.schema).parquet(f"{folder}/in"), measure, folder).awaitTermination()
        if steps or k == 2:
            closing.close(spark, closing.panes(arriving, measure).schema, measure, folder, length, slide).awaitTermination()
    return folder


def _windows(rows: DataFrame, measure: closing.Measure, length: str, slide: str | None = None, steps: bool = False) -> DataFrame:
    return rows.sparkSession.read.parquet(f"{_closed(rows, measure, length, slide, steps)}/windows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as served tickets. They arrive in two halves; every 97th comes after both, most of these too late."""
    rows = T.table(spark, sf_dir, "events")
    last = rows.agg(F.max("event_id")).first()[0] or 0
    stages = scoring.degraded({"draft": F.col("value") > 100, "triage": F.col("event_id") % 11 == 0})
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 97 == 5, 2).when(F.col("event_id") * 2 <= last, 0).otherwise(1).alias("arrival"), F.col("event_type").alias("route"), (F.col("event_type") == "error").alias("degraded"),
        F.create_map(F.lit("retrieval"), F.col("value") * 2, F.lit("draft"), F.col("value") * 200).alias("timings_ms"), stages["stages"].alias("stages"), F.when(F.col("user_id") % 3 == 0, "Timeout").otherwise("Throttled").alias("reason"),
        F.when(F.col("user_id") % 2 == 0, "triage").otherwise("draft").alias("stage"), (F.col("event_id") % 13 == 0).alias("rejected"), F.col("user_id").alias("input_tokens"), F.floor("value").cast("bigint").alias("output_tokens"),
    )


#: The rows that are in time (ot), those that are late (lt), and the watermark at the end (wm).
SQL_ARRIVED = """av AS (SELECT *, CASE WHEN event_id % 97 = 5 THEN 2 WHEN event_id * 2 <= (SELECT max(event_id) FROM events) THEN 0 ELSE 1 END AS b FROM events), mk AS (SELECT max(CASE WHEN b = 0 THEN ts END) AS m1, max(CASE WHEN b <= 1 THEN ts END) AS m2 FROM av),
ar AS (SELECT av.*, time_bucket(INTERVAL '1 minute', ts)::TIMESTAMP AS pane, coalesce(CASE b WHEN 1 THEN ts < m1 - INTERVAL '10 minutes' WHEN 2 THEN ts < m2 - INTERVAL '10 minutes' END, false) AS late FROM av, mk), ot AS (SELECT * FROM ar WHERE NOT late), lt AS (SELECT * FROM ar WHERE late), wm AS (SELECT max(pane) - INTERVAL '10 minutes' AS w FROM ot)"""


def _sql_windows(columns: str, by: str, source: str, minutes: int, slides: int = 1) -> str:
    """Closed windows of so many minutes over ``source``, as many starting in each length as slides say."""
    starts = f"time_bucket(INTERVAL '{minutes // slides} minutes', ts)::TIMESTAMP - INTERVAL '{minutes // slides} minutes' * i"
    return f"SELECT window_start, {by}{columns} FROM (SELECT *, {starts} AS window_start FROM ({source}), (SELECT unnest(range(0, {slides})) AS i)), wm WHERE window_start + INTERVAL '{minutes} minutes' <= w GROUP BY window_start{', ' + by.rstrip(', ') if by else ''}"


@register("stream_counts", f"WITH {SQL_ARRIVED} {_sql_windows('count(*) AS n', 'route, degraded, ', 'SELECT ts, event_type AS route, (event_type = ' + chr(39) + 'error' + chr(39) + ') AS degraded FROM ot', 1)}")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(_events(spark, sf_dir), telemetry.ticket_counts(), "1 minute", steps=True)


@register("stream_late", f"WITH {SQL_ARRIVED} SELECT event_type AS route, count(*) AS n, min(ts)::TIMESTAMP AS first_ts, max(ts)::TIMESTAMP AS last_ts FROM lt GROUP BY event_type")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side table of rows that came too late."""
    rows = _events(spark, sf_dir)
    late = closing.stored(spark, f"{_closed(rows, telemetry.ticket_counts(), '1 minute')}/late", rows.drop("arrival").schema)
    return late.groupBy("route").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))


@register("stream_degraded_share", f"WITH {SQL_ARRIVED} {_sql_windows('count(*) AS n, round(avg(d::INT), 9) AS share', '', 'SELECT ts, event_type = ' + chr(39) + 'error' + chr(39) + ' AS d FROM ot', 5, 5)}")
def stream_degraded_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five minutes, each minute one, made of panes of a minute."""
    rows = _windows(_events(spark, sf_dir), telemetry.flagged("degraded"), "5 minutes", "1 minute")
    return rows.select("window_start", "n", F.round(F.col("n_flagged") / F.col("n"), 9).alias("share"))


_STAGES = "SELECT ts, 'retrieval' AS stage, value * 2 / 1000 AS s FROM ot UNION ALL SELECT ts, 'draft', value * 200 / 1000 FROM ot"


@register("latency_buckets", f"WITH {SQL_ARRIVED} {_sql_windows('count(*) AS n, [count_if(s <= 0.01), count_if(s <= 0.05), count_if(s <= 0.1), count_if(s <= 0.25), count_if(s <= 0.5), count_if(s <= 1.0), count_if(s <= 2.5), count_if(s <= 5.0), count_if(s <= 10.0), count_if(s <= 30.0), count_if(s <= 60.0), count(*)] AS cumulative', 'stage, ', _STAGES, 5)}")
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency by stage in windows of five minutes."""
    arrived = _events(spark, sf_dir)
    timed = telemetry.stage_times(arrived.withColumn("ts", F.struct("ts", "arrival"))).select("ts.*", "stage", "seconds")
    return _windows(timed, telemetry.stage_latency(), "5 minutes").select("window_start", "stage", "n", telemetry.cumulative().alias("cumulative"))


@register("latency_p95", f"""WITH {SQL_ARRIVED}, bd AS (SELECT unnest(range(1, 12)) AS i, unnest([0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]) AS high), e AS ({_sql_windows('list(s) AS l, count(*) AS n', 'stage, ', _STAGES, 5)}),
k AS (SELECT window_start, stage, n, i, high, len(list_filter(l, lambda x: x <= high)) AS cum FROM e, bd), p AS (SELECT *, lag(cum, 1, 0) OVER o AS below, lag(high, 1, 0.0) OVER o AS low FROM k WINDOW o AS (PARTITION BY window_start, stage ORDER BY i)),
f AS (SELECT window_start, stage, arg_min(low + (high - low) * (0.95 * n - below) / (cum - below), i) AS p95 FROM p WHERE cum >= 0.95 * n GROUP BY ALL) SELECT window_start, stage, round(coalesce(p95, 60.0), 6) AS p95 FROM e LEFT JOIN f USING (window_start, stage)""")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile over five minutes by stage, from the buckets of closed windows."""
    timed = telemetry.stage_times(_events(spark, sf_dir).withColumn("ts", F.struct("ts", "arrival"))).select("ts.*", "stage", "seconds")
    return _windows(timed, telemetry.stage_latency(), "5 minutes").select("window_start", "stage", F.round(telemetry.bucket_quantile(telemetry.cumulative(), 0.95), 6).alias("p95"))


@register("stream_degrades", f"""WITH {SQL_ARRIVED} {_sql_windows('count(*) AS n', 'stage, reason, ', "SELECT ts, stage, CASE WHEN user_id % 3 = 0 THEN 'Timeout' ELSE 'Throttled' END AS reason FROM (SELECT *, 'draft' AS stage FROM ot WHERE value > 100 UNION ALL SELECT *, 'triage' FROM ot WHERE event_id % 11 = 0)", 5)}""")
def stream_degrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degraded stages by class of error: a slow event degrades the draft, every eleventh its triage."""
    return _windows(_events(spark, sf_dir).withColumn("stage", F.explode_outer("stages")), closing.Measure(["stage", "reason"], {"n": F.count("stage")}), "5 minutes").where("n > 0")


@register("stream_rejects", f"""WITH {SQL_ARRIVED} {_sql_windows('count_if(rejected) AS n_rejected, count(*) AS n', 'stage, ', "SELECT ts, CASE WHEN user_id % 2 = 0 THEN 'triage' ELSE 'draft' END AS stage, event_id % 13 = 0 AS rejected FROM ot", 5)}""")
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, and those that admission control turned away, by stage."""
    return _windows(_events(spark, sf_dir), telemetry.admission(), "5 minutes")


@register("arriving_tickets", f"WITH {SQL_TRIAGE} SELECT number, body_chars::INT AS body_chars, component, severity, confidence FROM tr")
def arriving_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets as a stream, scored and handed on batch by batch."""
    folder = _scratch(spark)
    rows = T.first_turns(spark, sf_dir)
    rows.write.parquet(f"{folder}/in")
    keep = lambda df: df.select("number", "body_chars", "triage.component", "triage.severity", "triage.confidence").write.mode("append").parquet(f"{folder}/out")
    feed.serve(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/state", keep, COMPONENTS, HIGH, MEDIUM).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@register("token_rates", f"""WITH {SQL_ARRIVED} {_sql_windows('sum(tokens)::BIGINT AS tokens', 'direction, ', "SELECT ts, d AS direction, CASE d WHEN 'input' THEN user_id ELSE floor(value)::BIGINT END AS tokens FROM ot, (VALUES ('input'), ('output')) t(d)", 1)}""")
def token_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = telemetry.token_flow(_events(spark, sf_dir).withColumn("ts", F.struct("ts", "arrival"))).select("ts.*", "direction", "tokens")
    return _windows(arrived, closing.Measure(["direction"], {"tokens": F.sum("tokens")}), "1 minute")


@register("stream_ledger", f"""WITH {T.SQL_CHANGES}, b AS (SELECT *, coalesce(lag(n_chunks) OVER (PARTITION BY path ORDER BY seq, op_no), 0) AS before FROM o),
g AS (SELECT seq, arg_min(before, op_no) AS chunks_before, arg_max(n_chunks, op_no) AS chunks_after FROM b GROUP BY seq) SELECT c.seq, c.path, change_type, old_path, chunks_before, chunks_after FROM c JOIN g USING (seq)""")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed followed in three batches, every seventh change a batch late or early: the same ledger as replaying all in order."""
    folder = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    rows = T.changes(spark, sf_dir)
    last = rows.agg(F.max("seq")).first()[0] or 0
    for k in range(3):
        own = F.floor(F.col("seq") * 3 / (last + 1))
        part = F.when(F.col("seq") % 7 == 3, (own + 1) % 3).otherwise(own) == k
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        # what has arrived since is one batch; what lacks a change before it waits
        feed.follow(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/log", f"{folder}/state").awaitTermination()
    return feed.read_ledger(spark, f"{folder}/log")
