"""Ordered content changes: classification, current and as-of views, ledger, pending changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def classify(lines: DataFrame, subtree: str, suffix: str = ".md") -> DataFrame:
    """(seq, change_type, path, old_path) of tab-separated status lines (seq, line). A rename out of the subtree is a deletion; other files go."""
    part = F.split("line", "\t", -1)
    status, first, second = part[0], F.get(part, F.lit(1)), F.get(part, F.lit(2))
    ours = lambda p: F.startswith(p, F.lit(subtree)) & F.endswith(p, F.lit(suffix))
    rename = F.startswith(status, F.lit("R")) & (F.size(part) == 3)
    plain = {"A": "added", "M": "modified", "D": "deleted"}
    kind = F.when(rename & ours(second), "renamed").when(rename & ours(first), "deleted")
    for code, name in plain.items():
        kind = kind.when((status == code) & ours(first), name)
    rows = lines.select("seq", kind.alias("change_type"), first.alias("a"), second.alias("b")).where("change_type IS NOT NULL")
    renamed = F.col("change_type") == "renamed"
    return rows.select("seq", "change_type", F.when(renamed, F.col("b")).otherwise(F.col("a")).alias("path"), F.when(renamed, F.col("a")).alias("old_path"))


def operations(changes: DataFrame) -> DataFrame:
    """(path, seq, op_no, n_chunks, payload): a rename deletes its old path, then writes the new one; a deleted page has no chunks.

    ``changes`` has seq, change_type, path, old_path, n_chunks (of the new page) and payload.
    """
    gone = F.col("change_type") == "deleted"
    write = F.struct(F.lit(1).alias("op_no"), F.col("path").alias("p"), F.when(gone, 0).otherwise(F.col("n_chunks")).cast("long").alias("n"), F.when(~gone, F.col("payload")).alias("d"), (~gone).alias("live"))
    drop = F.struct(F.lit(0).alias("op_no"), F.col("old_path").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(changes.schema["payload"].dataType).alias("d"), F.lit(False).alias("live"))
    ops = F.when(F.col("change_type") == "renamed", F.array(drop, write)).otherwise(F.array(write))
    return changes.select("seq", F.explode(ops).alias("o")).select(F.col("o.p").alias("path"), "seq", "o.op_no", F.col("o.n").alias("n_chunks"), F.col("o.d").alias("payload"), "o.live")


def view(changes: DataFrame, base: DataFrame | None = None, as_of: int | None = None) -> DataFrame:
    """(path, seq, n_chunks, payload): the pages that stand after all changes, or after those up to ``as_of``. ``base`` has path, n_chunks, payload."""
    ops = operations(changes if as_of is None else changes.where(F.col("seq") <= as_of))
    if base is not None:
        ops = ops.unionByName(base.select("path", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("op_no"), F.col("n_chunks").cast("long").alias("n_chunks"), "payload", F.lit(True).alias("live")))
    last = ops.groupBy("path").agg(F.max_by(F.struct("seq", "n_chunks", "payload", "live"), F.struct("seq", "op_no")).alias("l"))
    return last.where("l.live").select("path", "l.seq", "l.n_chunks", "l.payload")


def ledger(changes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(seq, path, change_type, old_path, chunks_before, chunks_after). A rename counts the chunks of its old path before."""
    ops = operations(changes).select("path", "seq", "op_no", "n_chunks")
    before = F.lag("n_chunks").over(Window.partitionBy("path").orderBy("seq", "op_no"))
    if base is None:
        ops = ops.withColumn("before", F.coalesce(before, F.lit(0)))
    else:
        held = base.select("path", F.col("n_chunks").cast("long").alias("base_n"))
        ops = ops.withColumn("lagged", before).join(held, "path", "left").withColumn("before", F.coalesce("lagged", "base_n", F.lit(0)))
    counts = ops.groupBy("seq").agg(F.min_by("before", "op_no").alias("chunks_before"), F.max_by("n_chunks", "op_no").alias("chunks_after"))
    return changes.select("seq", "path", "change_type", "old_path").join(counts, "seq")


def pending(changes: DataFrame, applied: int, n: int) -> DataFrame:
    """The next n changes after the high-water mark."""
    return changes.where(F.col("seq") > applied).orderBy("seq").limit(n)


def scripted_delete(changes: DataFrame, path: str) -> DataFrame:
    """``changes`` with one more: the page is deleted."""
    last = changes.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))
    return changes.unionByName(last.select("seq", F.lit("deleted").alias("change_type"), F.lit(path).alias("path")), allowMissingColumns=True)
