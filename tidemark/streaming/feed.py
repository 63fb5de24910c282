"""The change feed and arriving tickets as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions import scoring
from tidemark.operators import replay
from tidemark.sources.files import CHANGE, LEDGER
from tidemark.sources.shared import materialise
from tidemark.streaming.closing import stored

#: What stands in a bucket: ``after`` names the batch that wrote it, ``seq`` the last change of that batch.
HEAD = "bucket int, seq bigint, n_pages bigint, after bigint"
PAGE = "path string, n_chunks bigint, payload string"
BUCKETS = 32


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _ready(held: DataFrame, done: int) -> int:
    """The last number up to which no change is missing after ``done``. The first gap is found by an anti-join, so nothing is put in order here."""
    following = held.select((F.col("seq") + 1).alias("seq")).unionByName(held.sparkSession.createDataFrame([(done + 1,)], "seq long"))
    return following.join(held.select("seq"), "seq", "left_anti").agg(F.min("seq")).first()[0] - 1


def apply_batch(changes: DataFrame, folder: str, buckets: int = BUCKETS, first: int = 0) -> None:
    """Append the changes that are not applied yet, and their ledger rows, to the logs in ``folder``.

    Changes are numbered from ``first`` without a gap; one without a change_type counts and does nothing.
    They may arrive in any order: what is ready is applied, up to the first number that is missing, and the
    rest waits in ``waiting`` until it is there. A number that comes again after it was applied is kept in
    ``repeated``. So a shuffled feed gives the ledger of the ordered one, and no change is lost.

    Pages that stand are kept in ``buckets`` buckets of their path, always the same number for one
    folder. A batch reads the buckets that it touches and writes them anew, so its work does not grow
    with the log; what it knows of earlier batches is one row of ``heads`` a bucket and batch.

    Each batch writes folders named by the high-water mark that it starts from, ``heads`` last: what a
    batch cut off by a failure has written is overwritten when it is replayed, and a batch applied
    twice finds nothing fresh. Rows that wait may be written twice then; they are applied once.
    """
    spark = changes.sparkSession
    heads = stored(spark, f"{folder}/heads", HEAD)
    done = heads.agg(F.coalesce(F.max("seq"), F.lit(first - 1))).first()[0]
    here = f"after={done}"
    rows = materialise(changes.select(_columns(CHANGE)), "feed-batch")
    again = rows.where(F.col("seq") <= done)
    if not again.isEmpty():
        again.write.mode("append").parquet(f"{folder}/repeated/{here}")
    waiting = stored(spark, f"{folder}/waiting/{here}", CHANGE)
    arrived = materialise(rows.where(F.col("seq") > done).unionByName(waiting).dropDuplicates(["seq"]), "feed-arrived")
    last = _ready(arrived, done)
    late = arrived.where(F.col("seq") > last)
    if last == done:
        late.join(waiting.select("seq"), "seq", "left_anti").write.mode("append").parquet(f"{folder}/waiting/{here}")
        return
    late.write.mode("append").parquet(f"{folder}/waiting/after={last}")
    arrived.where(F.col("seq") <= last).write.mode("overwrite").parquet(f"{folder}/changes/{here}")
    fresh = spark.read.schema(CHANGE).parquet(f"{folder}/changes/{here}").where("change_type IS NOT NULL")
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    touched = [r[0] for r in replay.operations(fresh).select(bucket.alias("bucket")).distinct().collect()]
    held = heads.where(F.col("bucket").isin(touched)).groupBy("bucket").agg(F.max_by(F.struct("after", "n_pages"), "seq").alias("h"))
    paths = [f"{folder}/pages/after={r['h']['after']}/bucket={r['bucket']}" for r in held.where("h.n_pages > 0").collect()]
    base = spark.read.schema(PAGE).parquet(*paths) if paths else spark.createDataFrame([], PAGE)
    replay.ledger(fresh, base).select(_columns(LEDGER)).write.mode("overwrite").parquet(f"{folder}/ledger/{here}")
    pages = replay.view(fresh, base).select(*_columns(PAGE), bucket.alias("bucket"))
    pages.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/pages/{here}")
    written = dict(stored(spark, f"{folder}/pages/{here}", f"{PAGE}, bucket int").groupBy("bucket").count().collect())
    # a batch that touches no page moves the mark all the same
    marks = [(b, last, written.get(b, 0)) for b in touched] or [(-1, last, 0)]
    spark.createDataFrame(marks, "bucket int, seq bigint, n_pages bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/heads/{here}")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of the batches that are applied; rows of a batch that was cut off are left out."""
    done = stored(spark, f"{folder}/heads", HEAD).agg(F.max("seq")).first()[0]
    return stored(spark, f"{folder}/ledger", LEDGER).select(_columns(LEDGER)).where(F.col("seq") <= F.lit(done))


def read_waiting(spark: SparkSession, folder: str) -> DataFrame:
    """The changes that have arrived and wait for one before them."""
    done = stored(spark, f"{folder}/heads", HEAD).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    return stored(spark, f"{folder}/waiting/after={done}", CHANGE).dropDuplicates(["seq"])


def follow(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of changes, batch after batch, until what is there has been applied."""
    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: apply_batch(df, folder)).start()


def scored(tickets: DataFrame, *terms) -> DataFrame:
    """Arriving tickets (title, body, ...) with triage (by ``terms``, else by its own) and the inputs of the gate; row-wise, so it runs on streams."""
    text = F.concat_ws("\n", "title", "body")
    return tickets.withColumns({"triage": scoring.triage(text, *terms), "body_chars": F.length(F.coalesce("body", F.lit("")))})


def serve(tickets: DataFrame, checkpoint: str, answer: Callable[[DataFrame], None], *terms) -> StreamingQuery:
    """Hand each batch of scored tickets to ``answer``, which may rank and fuse: top-k windows need whole batches."""
    return scored(tickets, *terms).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: answer(df)).start()
