"""The best rows of each query, kept inside a partition before anything is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: A query side of at most so many rows and bytes is sent to all tasks; a larger one is shuffled.
SENT_ROWS, SENT_BYTES = 8192, 64 << 20


def sent(side: DataFrame, scale: int = 1) -> pa.Table | None:
    """The rows of a query side as one table if they are within ``scale`` times SENT_ROWS and within SENT_BYTES, else None. No more than one row beyond that is fetched."""
    most = SENT_ROWS * scale
    got = side.limit(most + 1).toArrow()
    return got if got.num_rows <= most and got.nbytes <= SENT_BYTES else None


class Best:
    """The k greatest values of each of n queries so far, ties by the lesser key."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.value, self.key = np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.int64)
        #: What a row must reach to be among the best of a query.
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, value: np.ndarray, key: np.ndarray) -> None:
        near = value >= self.least[query]
        if not near.any():
            return
        query, value, key = query[near], value[near], key[near]
        met = np.zeros(len(self.least), bool)
        met[query] = True
        own = met[self.query]  # only queries that get rows are ordered again
        rest = self.query[~own], self.value[~own], self.key[~own]
        query, value, key = (np.concatenate(x) for x in ((self.query[own], query), (self.value[own], value), (self.key[own], key)))
        order = np.lexsort((key, -value, query))
        query, value, key = query[order], value[order], key[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[query[place == self.k - 1]] = value[place == self.k - 1]
        kept = place < self.k
        self.query, self.value, self.key = (np.concatenate(x) for x in ((rest[0], query[kept]), (rest[1], value[kept]), (rest[2], key[kept])))


def ranked(rows: DataFrame, value: str, k: int, *by: str) -> DataFrame:
    """The k best rows of each query (and of each ``by``) over all partitions, with their rank."""
    order = Window.partitionBy("query_id", *by).orderBy(F.desc(value), "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
