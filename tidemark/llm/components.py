"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.storage import materialise


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for each node with an edge; label is the least node of its component.

    ``edges`` has columns a and b, in any direction, loops and repeats allowed. Each round is one
    grouping and one equi-join, whose output is written; rounds grow with the logarithm of the
    longest chain. Nothing but counts reaches the driver.
    """
    pairs = materialise(_tidy(edges), "edges")
    while True:
        least = lambda df: df.groupBy("u").agg(F.min("v").alias("m"))
        # large star: each greater neighbour of u is tied to the least node around u
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        around = least(both).select("u", F.least("u", "m").alias("m"))
        large = _tidy(both.join(around, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        large = materialise(large, "large-star")
        # small star: u and its lesser neighbours are tied to the least of them
        lesser = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = least(lesser)
        small = lesser.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        done, pairs = pairs, materialise(_tidy(small), "small-star")
        if _digest(done) == _digest(pairs):
            return pairs.select(F.col("b").alias("node"), F.col("a").alias("label")).union(pairs.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, from the lesser node to the greater, without loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
