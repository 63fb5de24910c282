"""Exact and cell-pruned nearest vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.topk import Best, ranked, sent
from tidemark.sources.shared import spread

QUERY_BLOCK, CORPUS_BLOCK, K = 1024, 16_384, 20
#: Rows of the corpus that meet the queries at a time inside a task.
ROWS = 2048
#: Fewest and most cells of an index; between them about the root of the number of rows.
CELLS = (16, 4096)


def _unit(rows: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    flat = rows.column(column)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class _Asked:
    """Queries, each with the groups in which it looks for rows."""

    def __init__(self, rows: pa.Table):
        rows = rows.filter(pc.is_valid(rows.column("g")))
        self.ids, self.query = np.unique(rows.column("query_id").to_numpy(), return_inverse=True)
        self.unit = _unit(rows, "qvec") if len(rows) else np.zeros((0, 0))
        groups = rows.column("g").to_numpy()
        self.of_group = {g: np.flatnonzero(groups == g) for g in np.unique(groups).tolist()}

    def meet(self, rows: pa.Table | pa.RecordBatch, best: Best) -> None:
        """Adds the rows' cosines with the queries of their group to ``best``."""
        if not len(rows):
            return
        unit, keys, groups = _unit(rows, "vec"), rows.column("key").to_numpy(), rows.column("g").to_numpy()
        for g in np.unique(groups).tolist():
            own = np.flatnonzero(groups == g)
            for at in range(0, len(self.of_group.get(g, ())), QUERY_BLOCK):
                asked = self.of_group[g][at : at + QUERY_BLOCK]
                scores = np.round(self.unit[asked] @ unit[own].T, 9)
                least = best.least[self.query[asked]]
                if len(own) > best.k:
                    least = np.maximum(least, np.partition(scores, -best.k, axis=1)[:, -best.k])
                q, r = np.nonzero(scores >= least[:, None])
                best.add(self.query[asked[q]], scores[q, r], keys[own[r]])

    def found(self, best: Best) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[best.query], pa.int64()), pa.array(best.key, pa.int64()), pa.array(best.value, pa.float64())], ["query_id", "key", "similarity"])


_FOUND = "query_id long, key long, similarity double"


def _scanned(asked: dict[str, pa.Table], corpus: DataFrame, k: int) -> DataFrame:
    """(list, query_id, key, similarity): for each list of queries (query_id, qvec, g) the k best rows of each partition of the corpus (key, vec, and a group column of each list's name). One pass, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [(name, queries := _Asked(rows), Best(len(queries.ids), k)) for name, rows in asked.items()]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                for name, queries, best in lists:
                    own = rows.select(["key", "vec", name]).rename_columns(["key", "vec", "g"])
                    queries.meet(own.filter(pc.is_valid(own.column("g"))) if own.column("g").null_count else own, best)
        for name, queries, best in lists:
            found = queries.found(best)
            yield pa.RecordBatch.from_arrays([pa.array([name] * found.num_rows, pa.string()), *found.columns], ["list", *found.schema.names])

    if max(map(len, asked.values())) > QUERY_BLOCK:  # then each row is much work
        corpus = spread(corpus)
    return corpus.mapInArrow(run, f"list string, {_FOUND}")


def _in_blocks(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k best rows for each query in each block of the corpus. Groups are cut into blocks of their queries and their rows; each pair of blocks is one task-sized product."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        held = _Asked(asked)
        best = Best(len(held.ids), k)
        for at in range(0, len(rows), ROWS):
            held.meet(rows.slice(at, ROWS), best)
        return pa.Table.from_batches([held.found(best)])

    blocks = lambda df, size, name: df.groupBy("g").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = blocks(corpus, CORPUS_BLOCK, "n_c").join(blocks(queries, QUERY_BLOCK, "n_q"), "g")
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(sizes, "g").select(F.col("g").alias("g"), "query_id", "qvec", block("query_id", "n_q").alias("qb"), each("n_c").alias("cb"))
    c = corpus.join(sizes, "g").select(F.col("g").alias("g"), "key", "vec", block("key", "n_c").alias("cb"), each("n_q").alias("qb"))
    key = "g", "qb", "cb"
    return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(run, _FOUND)


def _top(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k best rows of (key, vec, g) for each query of (query_id, qvec, g); a query may look into several groups."""
    corpus = corpus.where("vec IS NOT NULL AND g IS NOT NULL")
    asked = sent(queries := queries.where("qvec IS NOT NULL AND g IS NOT NULL"))
    found = _in_blocks(queries, corpus, k) if asked is None else _scanned({"g": asked}, corpus, k).drop("list")
    return ranked(found, "similarity", k)


def _group(same_tenant: bool) -> Column:
    return F.col("tenant_id").cast("long") if same_tenant else F.lit(0).cast("long")


def exact_top(queries: DataFrame, corpus: DataFrame, k: int = K, same_tenant: bool = False) -> DataFrame:
    """(query_id, key, similarity, rank) of the k most similar rows, ties by key; rows without a vector are not found.

    ``queries`` has query_id, qvec (and tenant_id), ``corpus`` key, vec (and tenant_id). A small batch of
    queries (a checked bound) is sent to all tasks: each keeps the k best rows of its partition, and
    only these are shuffled. A larger batch meets the corpus in pairs of blocks. No pair of rows is
    ever a row, and with same_tenant rows of other tenants never meet.
    """
    group = _group(same_tenant).alias("g")
    return _top(queries.select("query_id", "qvec", group), corpus.select("key", "vec", group), k)


def exact_lists(queries: DataFrame, corpus: DataFrame, lists: Mapping[str, bool], k: int = K) -> DataFrame:
    """(list, query_id, key, similarity, rank): ``exact_top`` for several named lists, with and without same_tenant, over one pass of the corpus. Rows and queries without a tenant are in the lists over all."""
    asked = sent(queries.select("query_id", "qvec", F.col("tenant_id").cast("long").alias("tenant")).where("qvec IS NOT NULL"))
    if asked is None:
        return reduce(DataFrame.unionByName, (exact_top(queries, corpus, k, same).withColumn("list", F.lit(name)) for name, same in lists.items()))
    rows = corpus.where("vec IS NOT NULL").select("key", "vec", *(_group(same).alias(name) for name, same in lists.items()))
    zero = pa.array(np.zeros(len(asked), np.int64))
    sides = {name: asked.select(["query_id", "qvec"]).append_column("g", asked.column("tenant") if same else zero) for name, same in lists.items()}
    return ranked(_scanned(sides, rows, k), "similarity", k, "list")


def wrong_dimension(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has another length; null vectors count as wrong."""
    return rows.where(F.coalesce(F.size(vector), F.lit(-1)) != dim)


class CellIndex:
    """Cells around k-means centres of unit vectors; every row is indexed, a query probes its nearest cells.

    The centres are fitted on a sample of at most about ``sample`` rows, drawn by a hash of the key.
    """

    def __init__(self, corpus: DataFrame, cells: int | None = None, sample: int = 20_000, seed: int = 3):
        n = max(1, corpus.count())
        part = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < min(1 << 20, -(-(sample << 20) // n))
        vectors = corpus.where(part).where("vec IS NOT NULL").select(array_to_vector("vec").alias("vector"))
        fitted = Normalizer(inputCol="vector", outputCol="features").transform(vectors)
        model = KMeans(k=cells or max(CELLS[0], min(CELLS[1], round(n**0.5))), seed=seed, maxIter=8).fit(fitted)
        self.centres = np.array(model.clusterCenters())

    def nearest(self, vector: str, n: int) -> Column:
        """The n nearest cells of a vector, nearest first: one product a batch."""
        centres = self.centres

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def cells(vectors: pa.Array) -> pa.Array:
            unit = _unit(pa.table({"v": vectors}), "v") if len(vectors) else np.zeros((0, centres.shape[1]))
            order = np.argsort((centres**2).sum(1) / 2 - unit @ centres.T, axis=1, kind="stable")[:, :n]
            return pa.array(order.tolist(), pa.list_(pa.int64()))

        return cells(vector)

    def assign(self, corpus: DataFrame) -> DataFrame:
        """(key, vec, g): every row with a vector and its cell, an index to keep."""
        return corpus.where("vec IS NOT NULL").select("key", "vec", F.element_at(self.nearest("vec", 1), 1).alias("g"))

    def calibrate(self, queries: DataFrame, assigned: DataFrame, exact: DataFrame, target: float = 0.95) -> int:
        """The fewest probes that reach the target recall on the queries with exact results; all cells reach 1."""
        order = queries.select("query_id", self.nearest("qvec", len(self.centres)).alias("cells"))
        # a neighbour is found as soon as its cell is probed
        place = F.array_position("cells", F.col("g"))
        needed = exact.select("query_id", "key").join(assigned.select("key", "g"), "key").join(order, "query_id").select(place.alias("place"))
        return int(needed.agg(F.expr(f"percentile_disc({target}) WITHIN GROUP (ORDER BY place)")).first()[0] or 1)

    def top(self, queries: DataFrame, assigned: DataFrame, k: int = K, probes: int = 4) -> DataFrame:
        """As ``exact_top``, but a query only meets the rows of the cells that it probes."""
        return _top(queries.select("query_id", "qvec", F.explode(self.nearest("qvec", probes)).alias("g")), assigned, k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, n_found, recall) of an approximate result."""
    hit = approximate.select("query_id", "key", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "key"], "left").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.try_divide("n_found", "n_exact"))


def embed(texts: DataFrame, text: str, model, dim: int) -> DataFrame:
    """``texts`` with a column ``embedding``; each distinct text is embedded once, in batches of 64, by ``model(list) -> array``.

    The model is a picklable callable that loads what it needs once in each worker; null texts get null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                vectors = np.asarray(model(part.column(0).to_pylist()), np.float32)
                if vectors.shape != (part.num_rows, dim):
                    raise ValueError(f"the model returned {vectors.shape} for {part.num_rows} texts of dimension {dim}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors.tolist(), pa.list_(pa.float32()))], ["_text", "embedding"])

    once = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct().mapInArrow(run, "_text string, embedding array<float>")
    return texts.join(once, texts[text] == once["_text"], "left").drop("_text")


def hashed_embedding(texts: DataFrame, key: str, tokens: str, dim: int = 64) -> DataFrame:
    """(key, embedding): unit vectors of hashed token counts, a stand-in where no model is given. Rows without tokens get zeros."""
    counted = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=dim).transform(texts)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.select(key, F.transform(vector_to_array("_unit"), lambda x: x.cast("float")).alias("embedding"))
