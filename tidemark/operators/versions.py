"""Page versions as intervals of change numbers, kept in layers, so that a past state is read and not replayed.

A version of a page holds from the change that made it up to the next change of the page. A layer covers a
range of change numbers and holds every version that is live in some part of it, cut to the range: its first
state whole, and what changed since. A state as of a change is the rows of one layer whose interval
holds the number; no other file is opened. Appended changes make a layer from the last state; ``compact``
puts layers that follow each other into one.

Changes are numbered; the state before the first is ``base`` (empty if there is none). A layer is
written before its row in ``layers``, which is what readers go by; a layer that was cut off is written
anew. Pages that a change rewrites more than once stand with the last of these writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators.replay import operations
from tidemark.streaming.closing import stored

#: Changes of a layer, about.
STEP = 1 << 20
_LAYER = "first bigint, upto bigint, turn bigint"
VERSION = "path string, seq bigint, since bigint, until bigint, n_chunks bigint, payload string"


def intervals(changes: DataFrame, upto: int, base: DataFrame | None = None, first: int = 0) -> DataFrame:
    """(path, seq, since, until, n_chunks, payload): versions that are live after some change from ``first`` - 1 to before ``upto``, with since included and until not.

    ``base`` has path, seq, n_chunks, payload of the state before ``first``; seq is the change that made a version.
    """
    ops = operations(changes).withColumn("since", F.col("seq"))
    if base is not None:
        ops = ops.unionByName(base.select("path", "seq", F.lit(-1).alias("op_no"), F.col("n_chunks").cast("long").alias("n_chunks"), "payload", F.lit(True).alias("live"), F.lit(first - 1).cast("long").alias("since")))
    order = Window.partitionBy("path").orderBy("since", "op_no")
    rows = ops.withColumn("until", F.coalesce(F.lead("since").over(order), F.lit(upto).cast("long")))
    return rows.where("live AND since < until").select("path", "seq", "since", "until", "n_chunks", "payload")


class Versions:
    """Layers of versions in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def layers(self) -> list[tuple[int, int, int]]:
        """(first change, the one after the last, turn) of each layer in use, in order; where ranges overlap, that of the latest turn counts."""
        found = sorted(tuple(r) for r in stored(self.spark, f"{self.folder}/layers", _LAYER).select("first", "upto", "turn").collect())
        return [a for a in found if not any(b[2] > a[2] and b[0] <= a[0] and a[1] <= b[1] for b in found)]

    def _path(self, first: int, turn: int) -> str:
        return f"{self.folder}/versions/layer-{first}-{turn}"

    def _write(self, rows: DataFrame, first: int, upto: int, turn: int) -> None:
        rows.repartitionByRange("since", "path").write.mode("overwrite").parquet(self._path(first, turn))
        self.spark.createDataFrame([(first, upto, turn)], _LAYER).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/layers/first_turn={first}_{turn}")

    def _layer(self, first: int, turn: int) -> DataFrame:
        return self.spark.read.schema(VERSION).parquet(self._path(first, turn))

    def append(self, changes: DataFrame, base: DataFrame | None = None, step: int = STEP) -> Versions:
        """Adds the changes that follow the last layer, in layers of ``step`` numbers; earlier ones are there already."""
        found = self.layers()
        bounds = changes.agg(F.min("seq"), F.max("seq")).first()
        if bounds[1] is None:
            return self
        at, last = (found[-1][1] if found else bounds[0]), bounds[1] + 1
        turn = max((x[2] for x in found), default=-1) + 1
        if found:
            base = self.as_of(at - 1)
        elif base is not None and "seq" not in base.columns:
            base = base.withColumn("seq", F.lit(-1).cast("long"))
        while at < last:
            upto = min(at + step, last)
            self._write(intervals(changes.where((F.col("seq") >= at) & (F.col("seq") < upto)), upto, base, at), at, upto, turn)
            at, base = upto, self.as_of(upto - 1)
        return self

    def as_of(self, seq: int) -> DataFrame:
        """(path, seq, n_chunks, payload): the pages that stand after change ``seq``, from the one layer that covers it."""
        found = [x for x in self.layers() if x[0] - 1 <= seq]
        if not found:
            raise ValueError(f"no layer covers change {seq}")
        first, upto, turn = found[-1]
        seq = min(seq, upto - 1)
        return self._layer(first, turn).where((F.col("since") <= seq) & (F.col("until") > seq)).select("path", "seq", "n_chunks", "payload")

    def history(self, path: str) -> DataFrame:
        """(since, until, n_chunks, payload) of each version of a page."""
        rows = [self._layer(first, turn) for first, _, turn in self.layers()]
        whole = rows[0]
        for r in rows[1:]:
            whole = whole.unionByName(r)
        return _joined(whole.where(F.col("path") == path)).select("since", "until", "n_chunks", "payload")

    def compact(self, first: int, upto: int) -> Versions:
        """One layer in place of those between two bounds of layers."""
        own = [x for x in self.layers() if first <= x[0] and x[1] <= upto]
        if not own or own[0][0] != first or own[-1][1] != upto:
            raise ValueError("compact takes whole layers")
        rows = self._layer(own[0][0], own[0][2])
        for f, _, turn in own[1:]:
            rows = rows.unionByName(self._layer(f, turn))
        self._write(_joined(rows), first, upto, max(x[2] for x in self.layers()) + 1)
        return self


def _joined(rows: DataFrame) -> DataFrame:
    """The parts of each version, which layers cut, put together. A page deleted and made again has versions of their own, since the change that made them differs."""
    found = rows.groupBy("path", "seq").agg(F.min("since").alias("since"), F.max("until").alias("until"), F.first("n_chunks").alias("n_chunks"), F.first("payload").alias("payload"))
    return found.select("path", "seq", "since", "until", "n_chunks", "payload")
