"""Windowed telemetry of served tickets. Each function takes a batch or a stream of the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.streaming.closing import Measure

LATE = "10 minutes"
#: Upper bounds of the latency buckets, in seconds.
BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def timed(events: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Event times as timestamps; on a stream with a watermark, so that windows close and later rows are dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late) if rows.isStreaming else rows


def _window(length: str, slide: str | None, ts: str) -> Column:
    return F.window(ts, length, slide) if slide else F.window(ts, length)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), *(c for c in df.columns if c != "window"))


def counts(events: DataFrame, by: Sequence[str], length: str = "1 minute", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows for each window and group; a slide gives a continuous look-back."""
    return _flat(events.groupBy(_window(length, slide, ts), *by).agg(F.count("*").alias("n")))


def degrades(events: DataFrame, stages: str = "stages", reason: str = "reason", length: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Degraded answers for each window, stage and class of error; ``stages`` is an array, each entry counts."""
    return counts(events.select(ts, F.explode(stages).alias("stage"), F.col(reason).alias("reason")), ["stage", "reason"], length, ts=ts)


def share(events: DataFrame, flag: str, length: str = "5 minutes", slide: str | None = "1 minute", ts: str = "ts") -> DataFrame:
    """Rows and the share of flagged rows in each window."""
    return _flat(events.groupBy(_window(length, slide, ts)).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("int")).alias("share")))


def buckets(events: DataFrame, value: str, by: Sequence[str], bounds: Sequence[float] = BOUNDS, length: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Cumulative counts (at most each bound, then all) for each window and group."""
    upto = F.array(*(F.count_if(F.col(value) <= b) for b in bounds), F.count("*"))
    return _flat(events.groupBy(_window(length, None, ts), *by).agg(upto.alias("cumulative")))


def bucket_quantile(cumulative: Column, q: float, bounds: Sequence[float] = BOUNDS) -> Column:
    """The quantile by linear interpolation inside its bucket; above the last bound, that bound."""
    edges = F.array(F.lit(0.0), *map(F.lit, bounds))
    rank = q * F.element_at(cumulative, -1)
    place = F.array_position(F.transform(cumulative, lambda c: c >= rank), True).cast("int")
    below = F.coalesce(F.try_element_at(cumulative, F.when(place > 1, place - 1)), F.lit(0))
    low, high = F.try_element_at(edges, place), F.try_element_at(edges, place + 1)
    inside = low + (high - low) * F.try_divide(rank - below, F.element_at(cumulative, place) - below)
    return F.when(F.element_at(cumulative, -1) == 0, None).when(place > len(bounds), bounds[-1]).otherwise(inside)


def token_rates(events: DataFrame, length: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Input and output tokens of each window, one row a direction."""
    rows = events.select(ts, F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), F.col(f"{d}_tokens").alias("tokens")) for d in ("input", "output")))).alias("t")).select(ts, "t.*")
    return _flat(rows.groupBy(F.window(ts, length), "direction").agg(F.sum("tokens").alias("tokens")))


def ticket_counts(by: Sequence[str] = ("route", "degraded")) -> Measure:
    """What ``counts`` counts, for windows that close."""
    return Measure(by, {"n": F.count("*")})


def flagged(flag: str) -> Measure:
    """Rows and flagged rows, the parts of ``share``."""
    return Measure([], {"n": F.count("*"), "n_flagged": F.count_if(F.col(flag))})


def stage_times(tickets: DataFrame, timings: str = "timings_ms", ts: str = "ts") -> DataFrame:
    """(ts, stage, seconds): a row for each stage that a ticket's map of milliseconds names."""
    return tickets.select(ts, F.explode(timings).alias("stage", "ms")).select(ts, "stage", (F.col("ms") / 1000).alias("seconds"))


def stage_latency(bounds: Sequence[float] = BOUNDS) -> Measure:
    """Rows up to each bound, and all, by stage."""
    return Measure(["stage"], {**{f"le_{i}": F.count_if(F.col("seconds") <= b) for i, b in enumerate(bounds)}, "n": F.count("*")})


def cumulative(bounds: Sequence[float] = BOUNDS) -> Column:
    """The sums of ``stage_latency`` as the array that ``bucket_quantile`` takes."""
    return F.array(*(F.col(f"le_{i}") for i in range(len(bounds))), F.col("n"))


def degraded_stages(events: DataFrame, stages: str = "stages", reason: str = "reason", ts: str = "ts") -> DataFrame:
    """(ts, stage, reason): a row for each degraded stage."""
    return events.select(ts, F.explode(stages).alias("stage"), F.col(reason).alias("reason"))


def admission(rejected: str = "rejected") -> Measure:
    """Calls by stage, and those that admission control turned away."""
    return Measure(["stage"], {"n_rejected": F.count_if(F.col(rejected)), "n": F.count("*")})


def token_flow(events: DataFrame, ts: str = "ts") -> DataFrame:
    """(ts, direction, tokens), one row a direction."""
    return events.select(ts, F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), F.col(f"{d}_tokens").alias("tokens")) for d in ("input", "output")))).alias("t")).select(ts, "t.*")
