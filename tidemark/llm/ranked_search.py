"""Ranked lexical search over bit-sliced Bloom signatures.

The index is a table of blocks of up to BLOCK_DOCS documents of like size. A document's signature
holds each of its terms, and the term again for each of TIERS that its count reaches; the block keeps
signatures slice by slice: one row of bits for each signature place, one bit a document. ANDing the
slices of a term gives a row of bits that may claim too much but never too little, so the highest tier
that is claimed bounds the count of the term in the document from above, and the weighted sum over the
terms of a query bounds its score.

A query batch is answered in three scans, all of them distributed: the documents with the greatest
bounds are scored exactly, which gives a score that the k best must reach; then every document whose
bound reaches it is scored exactly from its whole text. Only documents that provably miss the k best
are left out. Texts are rows of their own in the index: a scan over bounds reads none, and only those of
chosen documents are taken apart.

Terms are maximal runs of ASCII letters, digits and characters above U+007F, A to Z lower-cased, known
by a 64-bit hash. The index also keeps each block's distinct terms with the number of its documents
that hold them, so document counts of any term are exact sums.

Defined cases: a null or empty text has no terms and is never found; a null document id sorts last
among equal scores; repeated documents are documents of their own; rows of equal item id (null is an
id) make one item with the terms of all; an item without terms, or of an empty corpus, gives no row;
other columns, clashing names included, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import wordhash as W
from tidemark.llm.storage import materialise
from tidemark.operators.topk import Best, ranked, sent

U64 = np.uint64
#: A term is entered again for each of these counts that it reaches in the document.
TIERS = (1, 2, 3, 5, 9)
#: Signature bits for each entry of a block's largest document, and places an entry sets: about 0.6 % false claims.
BITS, HASHES = 12, 4
#: Documents and signature bits of a block at most (a document of more bits is a block of its own).
BLOCK_DOCS, BLOCK_BITS = 1024, 1 << 25
#: Texts are dealt into blocks by size among so many bytes of them.
GROUP_BYTES = 8 << 20
#: Most chosen documents that are sent to all tasks; more are joined by shuffle.
SENT_KEYS = 1_000_000
#: Query terms, query terms with repeats, and documents that are worked on at a time.
TERMS, ASKED, EXACT = 2048, 8192, 128
K = 10
#: Fixed value: what a term is made of.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20
#: Places of a document inside its block take so many bits of its key; blocks of a task so many more.
_PLACE, _BLOCK = 10, 30
#: A null document id stands behind all others.
_NO_ID = np.iinfo(np.int64).max

#: A row of a block has its signatures; a row of a document with terms has its key (block and place), id and text.
INDEX = "key long, doc long, text string, block long, sizes array<long>, most array<long>, n_docs long, n_terms long, slices binary, terms binary, counts binary"


def _places(hashes: np.ndarray, tier: int, j: int, bits: int) -> np.ndarray:
    entry = W.mix(hashes + U64((0xD6E8FEB86659FD93 * (2 * tier + 1)) & 0xFFFFFFFFFFFFFFFF))
    return ((entry + U64(j) * (W.mix(entry) | U64(1))) >> U64(11)) % U64(bits)


def _counted(data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term hash, count) of each distinct term of each text, by document, and the terms with repeats of each text."""
    w = W.words(_LOWERED[data], text_at, W.ALNUM)
    order = np.lexsort((w.hashes, w.doc))
    doc, term = w.doc[order], w.hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (np.diff(doc) != 0) | (np.diff(term) != 0)
    at = np.flatnonzero(fresh)
    return doc[at], term[at], np.diff(np.append(at, len(doc))), np.diff(w.word_at)


def _groups(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the first, documents, term hashes, counts, sizes) of about GROUP_BYTES of texts; hashes are made of a slice at a time."""
    held, begun, size, n = [], 0, 0, 0
    for row, data, text_at in W.slices(texts):
        doc, term, tf, sizes = _counted(data, text_at)
        held.append((doc + n, term, tf, sizes))
        n, size = n + len(sizes), size + len(data)
        if size >= GROUP_BYTES:
            yield (begun, *(np.concatenate(x) for x in zip(*held, strict=True)))
            held, begun, size, n = [], begun + n, 0, 0
    if held:
        yield (begun, *(np.concatenate(x) for x in zip(*held, strict=True)))


def blocks_of(texts: pa.Array) -> Iterator[dict]:
    """Index rows of blocks, without their number; ``rows`` are the places of their documents in ``texts``."""
    for row, doc, term, tf, size in _groups(texts):
        n = len(size)
        first = np.searchsorted(doc, np.arange(n + 1))
        tiers = sum((tf >= t).astype(np.int64) for t in TIERS)
        entries = W.per_text(tiers, first)
        order = np.argsort(entries, kind="stable")
        at = 0
        while at < n:
            least = int(entries[order[at]])
            end = at + 1
            while end < n and end - at < BLOCK_DOCS and entries[order[end]] <= 2 * least + 16 and BITS * int(entries[order[end]]) * (end - at + 1) <= BLOCK_BITS:
                end += 1
            own = np.sort(order[at:end])
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in own])
            place = np.repeat(np.arange(len(own)), np.diff(first)[own])
            bits = max(64, BITS * int(entries[order[end - 1]]))
            table = np.zeros((bits, len(own)), bool)
            for k, least_tf in enumerate(TIERS):
                in_tier = tf[rows] >= least_tf
                for j in range(HASHES):
                    table[_places(term[rows[in_tier]], k, j, bits), place[in_tier]] = True
            most = np.zeros(len(own), np.int64)
            np.maximum.at(most, place, tf[rows])
            terms, counts = np.unique(term[rows], return_counts=True)
            yield {"rows": row + own, "sizes": size[own], "most": most, "n_docs": int((size[own] > 0).sum()), "n_terms": int(size[own].sum()), "slices": np.packbits(table, axis=1).tobytes(), "terms": terms.tobytes(), "counts": counts.astype(np.uint32).tobytes()}
            at = end


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index rows of ``docs``; write them once and search them as often as needed."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in INDEX.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            for found in blocks_of(batch.column(2)):
                rows, block = found.pop("rows"), part << _BLOCK | n
                yield pa.RecordBatch.from_pylist([found | {"block": block}], schema=schema)
                worded = np.flatnonzero(found["sizes"])
                take = pa.array(rows[worded])
                own = {"key": pa.array((block << _PLACE) + worded), "doc": batch.column(1).take(take), "text": batch.column(2).take(take)}
                yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(len(worded), f.type) for f in schema], schema=schema)
                n += 1

    return docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, INDEX)


class Terms:
    """The items of one batch: their distinct terms, and which item asks for which."""

    def __init__(self, items: list[list[str]]):
        words = sorted({t for terms in items for t in terms})
        hashes = W.words(*_joined(words), W.ALNUM).hashes if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        place = {words[k]: i for i, k in enumerate(order)}
        self.hashes = hashes[order]
        #: Terms of all items one after the other, and where each item begins; every item has a term.
        self.flat = np.array([place[t] for terms in items for t in terms], np.int64)
        self.at = np.cumsum([0, *(len(terms) for terms in items)])
        self.weights = np.zeros(len(words), np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, n_docs: int, n_terms: int, held: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held + 1))).astype(np.int64)

    def length_factor(self, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes) or 90 * int(sizes.max()) * self.n_docs < 1 << 63:
            return 10 + 90 * sizes * self.n_docs // self.n_terms
        return np.array([10 + 90 * int(n) * self.n_docs // self.n_terms for n in sizes], np.int64)

    def over_items(self, values: np.ndarray) -> np.ndarray:
        """Sums (item, document) of values (term, document), each term once an item."""
        out = np.zeros((len(self.at) - 1, values.shape[1]), values.dtype)
        k = 0
        while k < len(out):
            end = max(k + 1, int(np.searchsorted(self.at, self.at[k] + ASKED, "right")) - 1)
            out[k:end] = np.add.reduceat(values[self.flat[self.at[k] : self.at[end]]], self.at[k:end] - self.at[k], axis=0)
            k = end
        return out

    def bounds(self, sizes: np.ndarray, most: np.ndarray, slices: bytes) -> np.ndarray:
        """No score (item, document) of a block is greater than these."""
        n = len(sizes)
        table = np.frombuffer(slices, np.uint8).reshape(-1, (n + 7) // 8)
        m = self.length_factor(sizes)
        # what a term's count can add at most, by the highest tier that is claimed
        caps = np.stack([np.zeros(n), *(_part(np.minimum(t - 1, most), m) for t in TIERS[1:]), _part(most, m)]).astype(np.float32)
        values = np.zeros((len(self.hashes), n), np.float32)
        for at in range(0, len(self.hashes), TERMS):
            hashes = self.hashes[at : at + TERMS]
            claimed = np.full((len(hashes), table.shape[1]), 255, np.uint8)
            level = np.zeros((len(hashes), n), np.uint8)
            for k in range(len(TIERS)):
                for j in range(HASHES):
                    claimed &= table[_places(hashes, k, j, len(table))]
                level += np.unpackbits(claimed, axis=1, count=n)
            values[at : at + TERMS] = self.weights[at : at + TERMS, None] * caps[level, np.arange(n)]
        # float32 sums of n values err by less than n * 2^-24 of the sum
        slack = np.float32(1 + 1e-6) + np.diff(self.at)[:, None].astype(np.float32) * np.float32(2e-7)
        return self.over_items(values) * slack

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Exact scores (item, document) of whole texts."""
        out = np.zeros((len(self.at) - 1, len(texts)), np.int64)
        for row, data, text_at in W.slices(texts):
            doc, term, tf, sizes = _counted(data, text_at)
            m = self.length_factor(sizes)
            place = np.minimum(np.searchsorted(self.hashes, term), len(self.hashes) - 1)
            ours = self.hashes[place] == term
            doc, place, tf = doc[ours], place[ours], tf[ours]
            for at in range(0, len(sizes), EXACT):
                n = min(EXACT, len(sizes) - at)
                mine = slice(*np.searchsorted(doc, [at, at + n]))
                values = np.zeros((len(self.hashes), n), np.int64)
                values[place[mine], doc[mine] - at] = self.weights[place[mine]] * _part(tf[mine], m[doc[mine]])
                out[:, row + at : row + at + n] = self.over_items(values)
        return out


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // np.maximum(1, 1000 * tf + 8 * m)


def _joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    coded = [w.encode() for w in words]
    return np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])


_FOUND = "query_id long, key long, value double"


def _found(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(best.query, pa.int64()), pa.array(best.key, pa.int64()), pa.array(best.value, pa.float64())], ["query_id", "key", "value"])


def _numbers(batch: pa.RecordBatch, column: str, k: int) -> np.ndarray:
    return batch.column(column)[k].values.to_numpy(zero_copy_only=False)


def _bounds(batch: pa.RecordBatch, terms: Terms) -> Iterator[tuple[int, np.ndarray]]:
    """(key of the first document, bounds) of each block."""
    for i in range(batch.num_rows):
        yield batch.column("block")[i].as_py() << _PLACE, terms.bounds(_numbers(batch, "sizes", i), _numbers(batch, "most", i), batch.column("slices")[i].as_py())


def _signatures(index: DataFrame) -> DataFrame:
    return index.where("slices IS NOT NULL").select("block", "sizes", "most", "slices")


def _greatest_bounds(index: DataFrame, terms: Terms, k: int) -> DataFrame:
    """(query_id, key, value): the k greatest bounds of each item in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(terms.at) - 1, k)
        for batch in batches:
            for first, bounds in _bounds(batch, terms):
                query, place = np.nonzero((bounds > 0) & (bounds >= best.least[:, None]))
                best.add(query, bounds[query, place].astype(np.float64), first + place)
        yield _found(best)

    return _signatures(index).mapInArrow(run, _FOUND)


def _reaching(index: DataFrame, terms: Terms, least: np.ndarray) -> DataFrame:
    """(key) of each document of which a bound reaches what the item asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bounds in _bounds(batch, terms):
                yield pa.RecordBatch.from_arrays([pa.array(first + np.flatnonzero((bounds >= least[:, None]).any(0)))], ["key"])

    return _signatures(index).mapInArrow(run, "key long")


def _scored(index: DataFrame, terms: Terms, chosen: DataFrame, least: np.ndarray, k: int) -> DataFrame:
    """(query_id, key, value): the k best exact scores of each item in each partition over the chosen documents, from ``least`` on; key is the document's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(terms.at) - 1, k)
        for batch in batches:
            keys = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, EXACT):
                scores = terms.scores(batch.column(1).slice(at, EXACT))
                query, n = np.nonzero((scores > 0) & (scores >= least[:, None]))
                best.add(query, scores[query, n].astype(np.float64), keys[at + n])
        yield _found(best)

    return index.where("text IS NOT NULL").select("key", "doc", "text").join(chosen, "key", "left_semi").select("doc", "text").mapInArrow(run, _FOUND)


def _held(index: DataFrame, terms: Terms) -> np.ndarray:
    """For each term of the batch the documents that hold it."""
    hashes = terms.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for held, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                held, counts = np.frombuffer(held.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.uint32)
                if len(held):
                    place = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
                    total += np.where(held[place] == hashes, counts[place], 0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["term", "n"])

    found = index.where("slices IS NOT NULL").select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(hashes), np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def _batches(items: DataFrame, at: int = 0, of: int = 1) -> Iterator[pa.Table]:
    """The items (item_id, terms) in batches of checked size; a batch that is too large is halved by a hash of the id."""
    own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(of)) == at)
    got = sent(own)
    if got is None and of < 1 << 30:
        yield from _batches(items, at, 2 * of)
        yield from _batches(items, at + of, 2 * of)
    else:
        yield own.toArrow() if got is None else got


def search(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents by an index; equal scores by document id, ranks from 1."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    asked = items.select(F.col(key).alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    asked = materialise(asked.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")), "search-items")
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    parts = []
    for batch in _batches(asked) if totals[1] else ():
        if not batch.num_rows:
            continue
        terms = Terms(batch.column("terms").to_pylist())
        terms.weigh(totals[0], totals[1], _held(index, terms))
        # at most k documents an item
        first = F.broadcast(materialise(ranked(_greatest_bounds(index, terms, k), "value", k).select("key").distinct(), "search-first"))
        least = np.ones(batch.num_rows)
        exact = ranked(_scored(index, terms, first, least, k), "value", k).where(F.col("rank") == k).select("query_id", "value").toArrow()
        least[exact.column("query_id").to_numpy()] = exact.column("value").to_numpy()
        chosen = materialise(_reaching(index, terms, least), "search-chosen")
        if chosen.count() <= SENT_KEYS:
            chosen = F.broadcast(chosen)
        found = ranked(_scored(index, terms, chosen, least, k), "value", k)
        names = items.sparkSession.createDataFrame([(i, v) for i, v in enumerate(batch.column("item_id").to_pylist())], f"query_id long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        named = found.join(F.broadcast(names), "query_id")
        parts.append(named.select("item_id", "rank", F.when(F.col("key") != _NO_ID, F.col("key")).alias("doc_id"), F.col("value").cast("long").alias("score")))
    if not parts:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ORACLE_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS terms FROM documents),
sizes AS (SELECT row_no, doc_id, len(terms)::BIGINT AS n FROM texts WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM sizes),
words AS (SELECT row_no, unnest(terms) AS term FROM texts),
tfs AS (SELECT row_no, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark),
weighed AS (SELECT item_id, term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM asked JOIN dfs USING (term), total),
found AS (
  SELECT item_id, row_no, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * all_docs) // all_terms)))))::BIGINT AS score
  FROM weighed JOIN tfs USING (term) JOIN sizes USING (row_no), total GROUP BY item_id, row_no
),
placed AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM found WHERE score > 0)
SELECT * FROM placed WHERE rank <= {K}
"""
