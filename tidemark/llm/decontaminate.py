"""Benchmark decontamination by size-partitioned MinHash containment search, verified exactly.

Words are runs of letters and digits of the lower-cased text, shingles five words. A document is
contaminated by an item if it holds at least 0.8 of the item's distinct shingles. An item of one to
four words is a shingle as a whole: it contaminates every document in which its words stand one after
the other. Documents get windows of such a size only if an item has it.

Items are partitioned by size, a power of two of their number of shingles. An item's signature is its
m least shingle hashes (bottom-m MinHash), with m set by the partition's upper bound u as
floor(0.2 u) + 1: a document that holds 0.8 of the item lacks at most m - 1 of its shingles, so one
of the m is in the document, however long it is. A document's shingles are probed against the
signatures of the partitions that its own size allows; candidates are then counted exactly.

All of it is DataFrame functions. The signatures are broadcast only if their measured size is at most
MOST_BROADCAST bytes, ROW for each row and the length of item_id as text; larger ones are joined by
shuffle.

Defined cases: null texts and texts without words have no shingles, so such items find nothing and such
documents are clean; repeated documents and items each give their own answer, rows
of equal doc_id and text one; documents without doc_id are told apart by their texts; empty tables
give an empty result. Only the named columns are read; ``drop_contaminated`` passes all columns
through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.storage import materialise

WORDS, CONTAINMENT = 5, 0.8
MOST_BROADCAST, ROW = 100_000_000, 100


def word_list(text: str | Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: str, short: Sequence[int] = ()) -> Column:
    """Hashes of all five-word windows, in text order, then of all windows of the sizes in ``short``; null or empty if there are none.

    A filter on this list or its size, and the null check of a join on it, would be pushed below the
    split and repeat it for every window. So rows without shingles stay, lists are unnested with
    ``explode_outer``, and sizes are counted from the words.
    """
    n = F.size(words)
    windows = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))))
    if not short:
        return windows(WORDS)
    return F.concat(*(F.coalesce(windows(k), F.array().cast("array<bigint>")) for k in (WORDS, *short)))


def _shingled(df: DataFrame, keep: list[str | Column], short: Sequence[int] = ()) -> DataFrame:
    """``keep``, the shingles of each row and n, how many of five words they are."""
    return df.select(*keep, word_list("text").alias("words")).select("*", shingles("words", short).alias("grams"), F.greatest(F.size("words") - WORDS + 1, F.lit(0)).alias("n")).drop("words")


def _items(items: DataFrame) -> DataFrame:
    """(item_id, item, short, size, grams): each item's distinct shingle hashes in rising order; item tells items of equal id apart, short is the number of words of an item below five."""
    n = F.size("words")
    whole = F.when(n == 1, F.array(F.xxhash64(F.get("words", 0))))
    for k in range(2, WORDS):
        whole = whole.when(n == k, F.array(F.xxhash64(*(F.get("words", j) for j in range(k)))))
    rows = items.select("item_id", F.xxhash64("text").alias("item"), word_list("text").alias("words"))
    rows = rows.select("item_id", "item", F.when(n.between(1, WORDS - 1), n).alias("short"), F.array_sort(F.array_distinct(F.coalesce(whole, shingles("words")))).alias("grams"))
    return rows.distinct().select("*", F.size("grams").alias("size"))


def _signatures(items: DataFrame) -> DataFrame:
    """(gram, item_id, item, least): the signature of each item, and the fewest five-word shingles of a document that can hold it."""
    upper = F.pow(2.0, F.floor(F.log2("size")) + 1) - 1
    m = F.floor((1 - CONTAINMENT) * upper + 1e-9).cast("int") + 1
    least = F.when(F.col("short").isNull(), F.ceil(CONTAINMENT * F.col("size") - 1e-9)).otherwise(0)
    rows = items.select("item_id", "item", least.alias("least"), F.slice("grams", F.lit(1), m).alias("signature"))
    return rows.select("item_id", "item", "least", F.explode("signature").alias("gram"))


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_found, containment) of each document and item with containment of 0.8 or more."""
    items = materialise(_items(items), "items").where("grams is not null")
    short = sorted(r[0] for r in items.where("short is not null").select("short").distinct().collect())  # 1 to 4
    signatures = _signatures(items)
    width = F.lit(ROW) + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0))
    if (signatures.agg(F.sum(width)).first()[0] or 0) <= MOST_BROADCAST:
        signatures = F.broadcast(signatures)
    probes = _shingled(docs, ["doc_id", F.xxhash64("text").alias("text_hash")], short).select("doc_id", "text_hash", "n", F.explode_outer("grams").alias("gram"))
    found = probes.join(signatures, "gram").where("n >= least").select("doc_id", "text_hash", "item_id", "item").distinct()
    found = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_id", "item")).alias("items")).withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_text"})
    found = materialise(found, "candidates")
    texts = docs.select("doc_id", "text").join(found, (F.xxhash64("text") == F.col("found_text")) & F.col("doc_id").eqNullSafe(F.col("found_id")))
    rows = _shingled(texts, ["doc_id", F.xxhash64("text").alias("text_hash"), "items"], short)
    rows = rows.select("doc_id", "text_hash", F.array_distinct("grams").alias("held"), F.explode("items").alias("i")).select("doc_id", "text_hash", "held", "i.*")
    rows = rows.withColumnsRenamed({"item_id": "found_item", "item": "found_hash"})
    whole = rows.join(items, F.col("found_item").eqNullSafe(F.col("item_id")) & (F.col("found_hash") == F.col("item")))
    whole = whole.select("doc_id", "text_hash", "item_id", F.col("size").alias("n_shingles"), F.size(F.array_intersect("held", "grams")).alias("n_found"))
    return whole.where(F.col("n_found") >= CONTAINMENT * F.col("n_shingles") - 1e-9).distinct().withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    hits = search(docs, items).select(F.col("doc_id").alias("leak·id"), F.col("text_hash").alias("leak·hash")).distinct()
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("leak·id")) & (F.xxhash64("text") == F.col("leak·hash")), "left_anti")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
     k AS (SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE len(w) > 0),
     ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
     bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
     f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_shingles AS INT) AS n_shingles, CAST(n_found AS INT) AS n_found, n_found / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found >= 0.8 * n_shingles - 1e-9
"""
