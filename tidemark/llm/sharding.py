"""Shards of near equal bytes by sampled splitters.

The key of a row is a hash of its text, so equal texts are one group. Rows are sampled with a
probability in proportion to their size; weighted quantiles of the sampled keys bound RANGES ranges
a shard, and a key that fills a range by itself gets a range of its own. Exact bytes of all ranges
show the overfull ones: these are subdivided, by key as long as several keys meet, by row (doc_id and
text) where one group exceeds a quarter of a shard, and by a random number drawn once for each row
where rows that are equal in both still do. Ranges go to shards largest first, each to the lightest shard.
A row's slot is its place in its range after the rows of the shard's earlier ranges.

The sample has SAMPLE rows a range in expectation and the driver sees one row for each range and
piece, both set by parameters and not by the data; no task sorts more than a piece of a range.

Defined cases: a null text counts as empty, so its size is 16 and it is in the group of empty texts;
ties in the order of slots are broken by doc_id, and equal rows are interchangeable; an empty table
gives an empty result. Other columns, clashing names included, pass through ``shard_rows``.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.storage import materialise

SHARDS, RANGES, SAMPLE, OVERHEAD = 40, 64, 8, 16
LAW = "bytes"


def _keyed(docs: DataFrame, extra: list[F.Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*extra, F.col("doc_id").alias("shard·doc"), (F.octet_length(text) + OVERHEAD).cast("long").alias("shard·size"), F.xxhash64(text).alias("shard·key"))


def _splitters(rows: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Rising keys; range i holds the keys from splitter i-1 up to below splitter i."""
    step = max(1.0, total / (ranges * SAMPLE))
    draw = F.pmod(F.xxhash64(F.lit(5), "shard·key", "shard·doc"), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(draw < F.col("shard·size") / step).select("shard·key", "shard·size").toPandas()
    keys, weights = got["shard·key"].to_numpy(np.int64), np.maximum(got["shard·size"].to_numpy(float), step)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys
    reached = np.cumsum(weights)
    bounds = keys[np.searchsorted(reached, reached[-1] * np.arange(1, ranges) / ranges)]
    single, first = np.unique(keys, return_index=True)
    of_key = np.add.reduceat(weights, first)
    heavy = single[of_key >= reached[-1] / ranges]
    return np.unique(np.concatenate([bounds, heavy, heavy[heavy < np.iinfo(np.int64).max] + 1]))


def _range_of(key: str, splitters: np.ndarray) -> F.Column:
    """How many splitters a key reaches: counted among the first ones of groups of about the root of their number, then in one group. It takes no Python worker beside a task's rows."""
    width = max(1, round(len(splitters) ** 0.5))
    groups = [splitters[i : i + width].tolist() for i in range(0, len(splitters), width)]
    if not groups:
        return F.lit(0)
    reached = lambda some: F.size(F.filter(some, lambda x: x <= F.col(key)))
    before = reached(F.lit([g[0] for g in groups]).cast("array<bigint>"))
    lists = F.array(*(F.lit(g).cast("array<bigint>") for g in groups))
    return F.when(before == 0, 0).otherwise((before - 1) * width + reached(F.get(lists, before - 1))).cast("int")


def _pieces(rows: DataFrame, total: int, shards: int) -> tuple[DataFrame, F.Column, F.Column]:
    """(range, by_key, by_row) for each overfull range: the number of pieces by key and by row; with the expressions of a row's pieces."""
    most = max(1.0, total / shards / 4)
    spark = rows.sparkSession
    by_key, by_row = F.pmod(F.xxhash64(F.lit(7), "shard·key"), F.coalesce("shard·keys", F.lit(1))), F.pmod(F.xxhash64(F.lit(8), "shard·doc", "shard·key"), F.coalesce("shard·rows", F.lit(1)))
    sizes = rows.groupBy("shard·range").agg(F.sum("shard·size").alias("n"), F.min("shard·key").alias("a"), F.max("shard·key").alias("b")).collect()
    found = [(r["shard·range"], 1 if r["a"] == r["b"] else -int(-4 * r["n"] // most), -int(-r["n"] // most) if r["a"] == r["b"] else 1) for r in sizes if r["n"] > most]
    return spark.createDataFrame(found, "`shard·range` int, `shard·keys` int, `shard·rows` int"), by_key.cast("int"), by_row.cast("int")


def _with_units(rows: DataFrame, splitters: np.ndarray, parts: tuple[DataFrame, F.Column, F.Column] | None) -> DataFrame:
    rows = rows.withColumn("shard·range", _range_of("shard·key", splitters))
    if parts is None:
        return rows
    found, by_key, by_row = parts
    return rows.join(F.broadcast(found), "shard·range", "left").withColumns({"shard·by_key": by_key, "shard·by_row": by_row}).drop("shard·keys", "shard·rows")


_UNIT = ["shard·range", "shard·by_key", "shard·by_row"]
_DRAWS = 1 << 20


def _drawn(rows: DataFrame) -> DataFrame:
    """``rows``, written with a random number each: no other column tells equal rows apart, and a row must not change its number."""
    return materialise(rows.withColumn("shard·draw", F.floor(F.rand(11) * _DRAWS).cast("int")), "shard-draws")


def _split(rows: DataFrame, overfull: DataFrame) -> DataFrame:
    """Units of ``overfull`` cut into shard·pieces pieces by the drawn number."""
    return rows.join(F.broadcast(overfull), _UNIT, "left").withColumn("shard·by_draw", F.floor(F.col("shard·draw") * F.coalesce("shard·pieces", F.lit(1)) / _DRAWS).cast("int")).drop("shard·pieces")


def _assigned(docs: DataFrame, extra: list[F.Column], shards: int) -> DataFrame:
    """``extra`` of each row with shard·shard and shard·slot."""
    spark = docs.sparkSession
    rows = materialise(_keyed(docs, []), "shard-keys")
    total = rows.agg(F.sum("shard·size")).first()[0] or 0
    splitters = _splitters(rows, total, shards * RANGES)
    parts = _pieces(_with_units(rows, splitters, None), total, shards)
    most, unit = max(1.0, total / shards / 4), _UNIT
    counted = lambda rows, by: rows.groupBy(*by).agg(F.sum("shard·size").alias("n"), F.max("shard·size").alias("one"), F.count("*").alias("rows"))
    units = counted(_with_units(rows, splitters, parts), unit).collect()
    rows = _keyed(docs, extra)
    # what a single long text or a few overfill can't be helped
    overfull = [(*(u[c] for c in unit), int(u["n"] // most) + 1) for u in units if u["n"] > 2 * max(most, u["one"])]
    if overfull:
        pieces = spark.createDataFrame(overfull, "`shard·range` int, `shard·by_key` int, `shard·by_row` int, `shard·pieces` int")
        rows, unit = _drawn(rows), [*_UNIT, "shard·by_draw"]
        units = counted(_split(_with_units(rows, splitters, parts), pieces), unit).collect()
    loads, placed, filled = [(0, s) for s in range(shards)], [], [0] * shards
    for u in sorted(units, key=lambda u: (-u["n"], *(u[c] for c in unit))):
        load, s = heapq.heappop(loads)
        heapq.heappush(loads, (load + u["n"], s))
        placed.append((*(u[c] for c in unit), s, filled[s]))
        filled[s] += u["rows"]
    # one row for each unit: at most three times the ranges and four pieces a shard and level
    plan = spark.createDataFrame(placed, ", ".join(f"`{c}` int" for c in unit) + ", `shard·shard` int, `shard·before` long")
    rows = _with_units(rows, splitters, parts)
    rows = (_split(rows, pieces) if overfull else rows).join(F.broadcast(plan), unit)
    place = F.row_number().over(Window.partitionBy(*unit).orderBy("shard·key", "shard·doc"))
    return rows.withColumn("shard·slot", F.col("shard·before") + place - 1)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is not by key) of each row."""
    rows = _assigned(docs, [F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")], shards)
    return rows.select(F.col("shard·doc").alias("doc_id"), F.col("shard·size").alias("size"), "text_crc32", F.lit(LAW).alias("law"), F.col("shard·shard").alias("shard"), F.col("shard·slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows with their columns, followed by shard and slot; a clashing column of the input keeps its place under the name input_shard or input_slot."""
    rows = _assigned(docs, [F.struct("*").alias("shard·row")], shards)
    named = [F.col(f"shard·row.`{c}`").alias(f"input_{c}" if c in ("shard", "slot") else c) for c in docs.columns]
    return rows.select(*named, F.col("shard·shard").alias("shard"), F.col("shard·slot").alias("slot"))
