"""Windows that close, late rows, replayed batches, and the state that is kept."""

import datetime as d
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import closing, telemetry

SCHEMA = "ts timestamp_ntz, route string, degraded boolean"
START = d.datetime(2024, 1, 1)


def push(spark, folder, rows, measure, length="1 minute", slide=None):
    """One batch arrives; returns the rows of state that are left."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    closing.follow(stream, measure, folder).awaitTermination()
    timed = spark.createDataFrame([], SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    query = closing.close(spark, closing.panes(timed, measure).schema, measure, folder, length, slide)
    query.awaitTermination()
    return query.lastProgress.stateOperators[0].numRowsTotal


def batches(n, rows, seed=1):
    """Rows that arrive in about the order of time; every 40th comes an hour late."""
    r, out, late = random.Random(seed), [], []
    for b in range(n):
        own = [(START + d.timedelta(minutes=30 * b + r.uniform(0, 30)), r.choice("ab"), r.random() < 0.3) for _ in range(rows)]
        late += own[::40]
        out.append([x for i, x in enumerate(own) if i % 40] + (late[:3] if b > 2 else []))
        late = late[3:] if b > 2 else late
    return out


def expected(parts, length, slide, flag=False):
    """(closed windows, late rows) in plain Python."""
    mark, late, kept = None, [], []
    for part in parts:
        for x in part:
            (late if mark and x[0] < mark - d.timedelta(minutes=10) else kept).append(x)
        mark = max([x[0] for x in part] + ([mark] if mark else []))
    pane = lambda t: t.replace(second=0, microsecond=0)
    end = max(pane(x[0]) for x in kept) - d.timedelta(minutes=10)
    windows = {}
    for t, route, degraded in kept:
        at = START + (t - START) // d.timedelta(minutes=slide) * d.timedelta(minutes=slide)
        for k in range(length // slide):
            begin = at - d.timedelta(minutes=slide) * k
            if begin + d.timedelta(minutes=length) <= end:
                key = (begin,) if flag else (begin, route, degraded)
                n, f = windows.get(key, (0, 0))
                windows[key] = n + 1, f + degraded
    return windows, late


@pytest.mark.parametrize(("length", "slide"), [(1, 1), (5, 1), (10, 5)])
def test_closed_windows_and_late_rows(spark, tmp_path, length, slide):
    folder, parts, measure = str(tmp_path / "s"), batches(6, 120), telemetry.flagged("degraded")
    for part in parts:
        push(spark, folder, part, measure, f"{length} minutes", None if length == slide else f"{slide} minutes")
    windows, late = expected(parts, length, slide, flag=True)
    got = {(r.window_start,): (r.n, r.n_flagged) for r in spark.read.parquet(f"{folder}/windows").collect()}
    assert got == windows and len(late) > 5
    side = closing.stored(spark, f"{folder}/late", SCHEMA.replace("_ntz", "")).collect()
    assert sorted((r.ts, r.route, r.degraded) for r in side) == sorted(late)
    assert sum(n for n, _ in windows.values()) > 300


def test_state_stays_bounded(spark, tmp_path):
    folder, measure = str(tmp_path / "s"), telemetry.ticket_counts()
    left = [push(spark, folder, part, measure) for part in batches(12, 60)]
    # no more than the panes of a batch and of the allowed lateness, in four groups, however long the stream is
    assert max(left) <= 4 * 42 and left[-1] <= max(left[:3]) * 1.5


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    measure, folder = telemetry.ticket_counts(["route"]), str(tmp_path / "s")
    at = lambda m: START + d.timedelta(minutes=m)
    make = lambda *rows: spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    first, second = make((at(0), "a", True), (at(30), "a", False), (None, "n", False)), make((at(5), "late", True), (at(25), "b", True))
    for k, batch in ((0, first), (0, first), (1, second), (1, second), (0, first)):
        closing.absorb(batch, k, measure, folder)
    panes = sorted((r.pane, r.route, r.n) for r in spark.read.parquet(f"{folder}/panes").collect())
    assert panes == [(at(0), "a", 1), (at(25), "b", 1), (at(30), "a", 1)]
    late = closing.stored(spark, f"{folder}/late", SCHEMA.replace("_ntz", ""))
    assert sorted(r.route for r in late.collect()) == ["late", "n"]
    closing.absorb(make((at(1), "late", True)), 2, measure, folder)
    assert spark.read.parquet(f"{folder}/panes").count() == 3 and late.count() == 2
    assert closing.stored(spark, f"{folder}/late", SCHEMA.replace("_ntz", "")).count() == 3
    closing.absorb(make().limit(0), 3, measure, folder)
    whole = closing.windows(spark.read.parquet(f"{folder}/panes"), measure, "1 hour").collect()
    assert sorted((r.route, r.n) for r in whole) == [("a", 2), ("b", 1)]


def test_stage_latency(spark):
    rows = spark.createDataFrame([(START, {"draft": 10.0, "triage": 70_000.0}), (START, {"draft": 10.1}), (START, None)], "ts timestamp, timings_ms map<string,double>")
    panes = closing.panes(telemetry.stage_times(rows), telemetry.stage_latency())
    got = {r.stage: (r.c, r.q) for r in panes.select("stage", telemetry.cumulative().alias("c"), telemetry.bucket_quantile(telemetry.cumulative(), 0.5).alias("q")).collect()}
    assert got["draft"] == ([1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2], 0.01) and got["triage"] == ([0] * 11 + [1], 60.0)
    assert telemetry.BOUNDS == (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
