"""Windows that close: arriving rows become panes, panes become windows, late rows go to a side table.

``absorb`` takes each batch of a stream. Rows older than the greatest time of earlier batches less the
allowed lateness are late; they are kept apart. The others are summed up by pane and group, so what goes
on is a row a pane and group, not a row an event. ``windows`` follows the panes as a stream of its own:
a window, tumbling or sliding, is the sum of its panes, is written once when the watermark has passed its
end, and leaves the state then. Both keep the same lateness, a whole number of panes, so no pane comes
too late for its window and nothing is dropped.

A batch writes folders named by its number, the panes last; a batch that is replayed after its panes are
there changes nothing. Rows without a time are late rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

PANE, LATE = "1 minute", "10 minutes"
_MARK = "at timestamp"


@dataclass(frozen=True)
class Measure:
    """What is measured: groups, and sums by name as aggregates that add up over panes (counts and sums)."""

    by: Sequence[str]
    sums: Mapping[str, Column]
    ts: str = "ts"
    pane: str = PANE
    late: str = LATE


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder; none before it is written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def panes(rows: DataFrame, measure: Measure) -> DataFrame:
    """(pane, groups, sums) of timed rows."""
    found = rows.groupBy(F.window(measure.ts, measure.pane).alias("w"), *measure.by).agg(*(c.alias(name) for name, c in measure.sums.items()))
    return found.select(F.col("w.start").alias("pane"), *measure.by, *measure.sums)


def absorb(batch: DataFrame, number: int, measure: Measure, folder: str) -> None:
    """Splits one batch into late rows and panes, below ``folder``."""
    spark = batch.sparkSession
    schema = panes(batch, measure).schema
    if not stored(spark, f"{folder}/panes/batch={number}", "pane timestamp").isEmpty():
        return
    mark = stored(spark, f"{folder}/marks", f"{_MARK}, batch int").where(F.col("batch") < number).agg(F.max("at")).first()[0]
    time = F.col(measure.ts)
    is_late = time.isNull() if mark is None else time.isNull() | (time < F.lit(mark) - F.expr(f"INTERVAL {measure.late}"))
    batch.where(is_late).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
    batch.agg(F.max(time).alias("at")).where("at IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")
    made = panes(batch.where(~is_late), measure)
    spark.createDataFrame([], schema).unionByName(made).write.mode("overwrite").parquet(f"{folder}/panes/batch={number}")


def windows(stream: DataFrame, measure: Measure, length: str, slide: str | None = None) -> DataFrame:
    """(window_start, groups, sums) of closed windows over a stream of panes (or of all windows over a table of panes)."""
    rows = stream.withWatermark("pane", measure.late) if stream.isStreaming else stream
    window = F.window("pane", length, slide) if slide else F.window("pane", length)
    found = rows.groupBy(window.alias("w"), *measure.by).agg(*(F.sum(name).alias(name) for name in measure.sums))
    return found.select(F.col("w.start").alias("window_start"), *measure.by, *measure.sums)


def follow(events: DataFrame, measure: Measure, folder: str) -> StreamingQuery:
    """Absorbs a stream, batch after batch, until what is there has been taken."""
    timed = events.withColumn(measure.ts, F.col(measure.ts).cast("timestamp"))
    return timed.writeStream.option("checkpointLocation", f"{folder}/absorbed").trigger(availableNow=True).foreachBatch(lambda df, n: absorb(df, n, measure, folder)).start()


def close(spark: SparkSession, schema, measure: Measure, folder: str, length: str, slide: str | None = None) -> StreamingQuery:
    """Appends the windows that have closed to ``folder/windows``."""
    stream = spark.readStream.schema(schema).parquet(f"{folder}/panes")
    return windows(stream, measure, length, slide).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/closed").trigger(availableNow=True).start()
