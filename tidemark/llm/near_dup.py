"""Near-duplicate classes by Order MinHash and banded alignment.

Words are runs of letters and digits (all non-ASCII characters count as letters) of the lower-cased
text; shingles are five words, labelled with their occurrence number in the text. Two texts are
linked if M / (n1 + n2 - M) >= 0.8, where n counts labelled shingles and M is the longest common
subsequence of the two within a band of (n1 + n2) / 9 positions, beyond which no pair can reach 0.8.

Each of SKETCHES hash functions takes the ELL least labelled shingles and hashes them in text order
(Order MinHash), so that texts with the same shingles in another order differ. A linked pair shares
one sketch with probability p of about 0.64 at least (0.60 for texts of five to ten shingles), so all
SKETCHES differ with probability (1 - p) ** SKETCHES: below 1e-7, and 5e-7 for short texts.

Equal word sequences are one node, so copies are never compared. First each node is aligned with the
one leader it shares most sketches with. Then the buckets of equal sketches that still hold several
classes are compared in full: blocks of their nodes meet blocks of those outside the largest class,
all pairs of different classes are filtered by the exact count of common shingles and aligned, and
a block hands on verified links only. Classes are the connected components.

Defined cases: a text with one to four words has one shingle of all its words; null texts and texts
without words are classes of their own; repeated rows are copies; rows whose doc_id is null are
grouped like others, and a class whose doc_ids are all null has a null class_id; an empty table gives
an empty result. Columns other than doc_id and text are not read, and pass through ``drop_copies``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.llm import wordhash as W
from tidemark.llm.components import connected
from tidemark.llm.storage import materialise

WORDS, SIMILARITY, SKETCHES, ELL = 5, 0.8, 16, 2
#: Bytes of the texts of pairs whose shingles are held at a time.
PAIR_BYTES = 1 << 20
#: Most nodes and shingles of a block of a bucket, about; several small buckets share a block.
BLOCK_NODES, BLOCK_GRAMS = 2048, 1 << 20
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | W.U64(1)
_SKETCH = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("n_grams", T.IntegerType()), T.StructField("sketches", T.ArrayType(T.LongType()))])


def labelled(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each text's shingles and the count, hashes with their occurrence number, plain hashes), in text order."""
    at, gram = W.grams(w, WORDS, short=True)
    doc = w.doc[at]
    key = gram ^ W.mix(doc.astype(np.uint64) + W.U64(1))
    order = np.argsort(key)
    same, plain = np.diff(key[order]) == 0, gram
    if same.any():
        again = np.zeros(len(key), bool)
        again[1:] |= same
        again[:-1] |= same
        again = np.sort(order[again])  # in text order
        by_key = again[np.argsort(key[again], kind="stable")]
        fresh = np.ones(len(by_key), bool)
        fresh[1:] = np.diff(key[by_key]) != 0
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(by_key)), 0))
        gram = gram.copy()
        gram[by_key] = W.mix(gram[by_key] + (np.arange(len(by_key)) - first).astype(np.uint64) * W.U64(0x9E3779B97F4A7C15))
    return np.searchsorted(doc, np.arange(len(w.text_at))), gram, plain


def _order_minhash(at: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A row of SKETCHES for each text with a shingle: at marks starts, all texts have one at least."""
    out = np.empty((len(at), SKETCHES), np.uint64)
    n, ends, index = len(grams), np.append(at[1:], len(grams)), np.arange(len(grams))
    owner = np.repeat(np.arange(len(at)), ends - at)
    for s in range(SKETCHES):
        # a bijection of the hash for each seed; the least ELL by repeated minima
        value = W.mix(grams * _SEEDS[s] + W.U64(s))
        places = []
        for _ in range(ELL):
            least = np.minimum.reduceat(value, at)
            hit = index[value == least[owner]]
            place = hit[np.searchsorted(hit, at)]
            places.append(np.where(least == W.U64(0xFFFFFFFFFFFFFFFF), n, place))
            value[place] = W.U64(0xFFFFFFFFFFFFFFFF)
        places = np.sort(np.stack(places), axis=0)
        row = np.full(len(at), W.U64(s + 1))
        padded = np.append(grams, W.U64(0))
        for place in places:
            row = W.mix(row * W.U64(0xC2B2AE3D27D4EB4F) + padded[place])
        out[:, s] = row
    return out


def _keys(w: W.Words) -> list[bytes | None]:
    """128 bits of each text's word sequence; none without words."""
    n = len(w.text_at) - 1
    place = W.mix((np.arange(len(w.hashes)) - w.word_at[:-1][w.doc]).astype(np.uint64))
    halves = []
    for seed in (W.U64(3), W.U64(5)):
        total = np.zeros(len(w.hashes) + 1, np.uint64)
        np.cumsum(W.mix(w.hashes * seed + place), out=total[1:])
        halves.append(W.mix(total[w.word_at[1:]] - total[w.word_at[:-1]]))
    raw, count = np.stack(halves, 1).tobytes(), np.diff(w.word_at)
    return [raw[16 * i : 16 * i + 16] if count[i] else None for i in range(n)]


@F.arrow_udf(_SKETCH)
def _sketch_of(texts: pa.Array) -> pa.Array:
    keys: list[bytes | None] = []
    counts, lists = [np.zeros(0, np.int32)], [np.zeros((0, SKETCHES), np.uint64)]
    for _, data, text_at in W.slices(texts):
        w = W.words(data, text_at, W.ALNUM)
        keys += _keys(w)
        at, grams, _ = labelled(w)
        n = np.diff(at)
        counts.append(n.astype(np.int32))
        if len(grams):
            lists.append(_order_minhash(at[:-1][n > 0], grams))
    W.give_back()
    counts, values = np.concatenate(counts), np.concatenate(lists).view(np.int64).ravel()
    sizes = np.where(counts > 0, SKETCHES, 0)
    sketches = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))
    return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(counts), sketches], ["node", "n_grams", "sketches"])


def _rising(values: list[int]) -> int:
    """Length of the longest rising subsequence."""
    tails: list[int] = []
    for v in values:
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose positions differ by ``band`` at most, row by row."""
    width = 2 * band + 1
    padded = np.concatenate([np.zeros(band, a.dtype), b, np.zeros(max(0, len(a) - len(b)) + width, a.dtype)])
    row = np.zeros(width + 1, np.int64)  # row[o]: best with b up to i + o - band
    for i in range(len(a)):
        row[:width] = np.maximum.accumulate(np.maximum(row[1:], row[:width] + (padded[i : i + width] == a[i])))
    return int(row[len(b) - len(a) + band])


def aligned(a: np.ndarray, b: np.ndarray, plain_a: np.ndarray, plain_b: np.ndarray) -> int:
    """Length of the longest common subsequence within the band; 0 if it can't reach SIMILARITY.

    a and b are labelled, so their hashes are distinct: a rising subsequence of the matched places is
    common to both, and the longest one where no shingle repeats. Where some do, labels may pair the
    wrong occurrences; then the plain shingles are aligned.
    """
    both = len(a) + len(b)
    needed = SIMILARITY * both / (1 + SIMILARITY) - 1e-9
    if min(len(a), len(b)) < needed:
        return 0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < needed:
        return 0
    band = int(both - 2 * needed) + 1
    near = np.abs(ia - ib) <= band
    places = ib[near][np.argsort(ia[near])]
    m = len(places) if (np.diff(places) > 0).all() else _rising(places.tolist())
    if m < needed and not (np.array_equal(a, plain_a) and np.array_equal(b, plain_b)):
        m = _banded(plain_a, plain_b, band)
    return m


def _pair_runs(left: pa.Array, right: pa.Array) -> Iterator[slice]:
    """Runs of pairs of about PAIR_BYTES; a longer pair is alone."""
    size = sum((pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right)), np.zeros(len(left), np.int64))
    ends, at = np.cumsum(size), 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_BYTES, "right")))
        yield slice(at, to)
        at = to


def similarity(left: pa.Array, right: pa.Array) -> list[float]:
    """M / (n1 + n2 - M) of each pair of lower-cased texts; 0 below SIMILARITY at the latest."""
    out = []
    for run in _pair_runs(left, right):  # the shingles of so many pairs are held at a time
        sides = []
        for texts in (left[run], right[run]):
            grams: list[tuple[np.ndarray, np.ndarray]] = []
            for _, data, text_at in W.slices(texts):
                at, *hashes = labelled(W.words(data, text_at, W.ALNUM))
                grams += zip(*(np.split(x, at[1:-1]) for x in hashes), strict=True)
            sides.append(grams)
        for (a, plain_a), (b, plain_b) in zip(*sides, strict=True):
            m = aligned(a, b, plain_a, plain_b)
            out.append(m / max(1, len(a) + len(b) - m))
    return out


@F.arrow_udf(T.DoubleType())
def _similarity_of(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(similarity(left, right), pa.float64())


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts align."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return rows.where(_similarity_of("text_a", "text_b") >= SIMILARITY - 1e-9).select("a", "b")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(node, sketch) of all buckets with two nodes or more."""
    rows = nodes.select("node", F.explode("sketches").alias("sketch"))
    return rows.join(rows.groupBy("sketch").agg(F.count("*").alias("n")).where("n > 1").select("sketch"), "sketch", "left_semi")


def _first_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): each node and the leader of its buckets with which it shares most sketches, two at least.

    A bucket's leader is drawn by a hash that differs from sketch to sketch, so rows grow with the members.
    """
    drawn = members.groupBy("sketch").agg(F.min(F.struct(F.xxhash64("sketch", "node").alias("d"), F.col("node").alias("b"))).alias("l"))
    met = members.join(drawn, "sketch").select(F.col("node").alias("a"), F.col("l.b").alias("b")).where("a <> b").distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sketches").alias(f"sketches_{c}"))
    met = met.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("sketches_a", "sketches_b"))).where("shared >= 2")
    nearest = Window.partitionBy("a").orderBy(F.desc("shared"), F.xxhash64("a", "b"))  # at most SKETCHES rows
    return met.withColumn("place", F.row_number().over(nearest)).where("place = 1").select("a", "b")


class _Side:
    """The rows of a block: codes of nodes and labels, sketches, shingles as they are asked for."""

    def __init__(self, table: pa.Table, node_code: dict[bytes, int], label_code: dict[bytes, int]):
        self.node = np.array([node_code[x] for x in table.column("node").to_pylist()], np.int64)
        self.label = np.array([label_code[x] for x in table.column("label").to_pylist()], np.int64)
        self.sketches = table.column("sketches").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCHES)
        self.n = table.column("n_grams").to_numpy().astype(np.int64)
        self.sketch = table.column("sketch").to_numpy()
        self.text = table.column("text").combine_chunks()

    def grams(self, rows: np.ndarray, kept: dict) -> None:
        """Puts (labelled, plain) shingles of the rows into ``kept`` by node."""
        rows = np.array([r for r in dict(zip(self.node[rows].tolist(), rows.tolist(), strict=True)).values() if self.node[r] not in kept], np.int64)
        if not len(rows):
            return
        for first, data, text_at in W.slices(self.text.take(pa.array(rows))):
            at, *hashes = labelled(W.words(data, text_at, W.ALNUM))
            found = zip(*(np.split(x, at[1:-1]) for x in hashes), strict=True)
            kept.update(zip(self.node[rows[first : first + len(text_at) - 1]].tolist(), found, strict=True))


def _links_of_bucket(a: _Side, ra: np.ndarray, b: _Side, rb: np.ndarray, asks: np.ndarray, sketch: int, kept: dict, top) -> None:
    """Joins, with ``top``, the classes of the rows ra of a and rb of b of one bucket that hold a linked pair.

    ``asks`` flags the rows of b that also stand in a: such a pair is met from its lesser node. A pair that
    shares an earlier sketch is met in that bucket.
    """
    own = int(np.argmax(a.sketches[ra[0]] == sketch))
    n_a, n_b = a.n[ra][:, None], b.n[rb][None, :]
    open_ = (a.label[ra][:, None] != b.label[rb][None, :]) & (np.minimum(n_a, n_b) >= SIMILARITY * (n_a + n_b) / (1 + SIMILARITY) - 1e-9)
    open_ &= ~asks[rb][None, :] | (a.node[ra][:, None] < b.node[rb][None, :])
    for s in range(own):
        open_ &= a.sketches[ra, s][:, None] != b.sketches[rb, s][None, :]
    if not open_.any():
        return
    some_a, some_b = open_.any(axis=1), np.flatnonzero(open_.any(axis=0))
    a.grams(ra[some_a], kept)
    b.grams(rb[some_b], kept)
    held = [kept[k][0] for k in b.node[rb[some_b]].tolist()]
    gram, owner = np.concatenate(held), np.repeat(some_b, [len(x) for x in held])
    order = np.argsort(gram)
    gram, owner = gram[order], owner[order]
    for i in np.flatnonzero(some_a):
        mine, plain = kept[int(a.node[ra[i]])]
        ours = top(a.label[ra[i]])
        seek = open_[i] & (top(b.label[rb]) != ours)
        if not seek.any():
            continue
        # the exact count of common labelled shingles with each row of b
        low, high = np.searchsorted(gram, mine, "left"), np.searchsorted(gram, mine, "right")
        many = high - low
        at = np.repeat(low - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=len(rb))
        near = np.flatnonzero(seek & (common >= SIMILARITY * (len(mine) + b.n[rb]) / (1 + SIMILARITY) - 1e-9))
        for j in near[np.argsort(-common[near], kind="stable")]:
            if top(b.label[rb[j]]) == top(a.label[ra[i]]):
                continue
            other, other_plain = kept[int(b.node[rb[j]])]
            m = aligned(mine, other, plain, other_plain)
            if m / max(1, len(mine) + len(other) - m) >= SIMILARITY - 1e-9:
                top(a.label[ra[i]], b.label[rb[j]])


def _links_of_block(asking: pa.Table, members: pa.Table) -> pa.Table:
    """(a, b): labels of classes that a linked pair of the block joins, a spanning forest of them."""
    label_of = sorted(set(asking.column("label").to_pylist()) | set(members.column("label").to_pylist()))
    node_of = sorted(set(asking.column("node").to_pylist()) | set(members.column("node").to_pylist()))
    root, links = np.arange(len(label_of)), []

    def top(x, y=None):
        """The root of one label or many; with y the classes of both are joined."""
        if y is None:
            return root[x]
        links.append((label_of[x], label_of[y]))
        root[root == root[y]] = root[x]

    if len(asking) and len(members):
        codes = [dict(zip(x, range(len(x)), strict=True)) for x in (node_of, label_of)]
        a, b, kept = _Side(asking, *codes), _Side(members, *codes), {}
        asks = members.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        by_a, by_b = np.argsort(a.sketch, kind="stable"), np.argsort(b.sketch, kind="stable")
        sorted_a, sorted_b = a.sketch[by_a], b.sketch[by_b]
        for sketch in np.unique(sorted_a):
            ra, rb = (by[np.searchsorted(x, sketch, "left") : np.searchsorted(x, sketch, "right")] for by, x in ((by_a, sorted_a), (by_b, sorted_b)))
            if len(rb):
                _links_of_bucket(a, ra, b, rb, asks, sketch, kept, top)
        del a, b, kept
        W.give_back()
    return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})


def _open_links(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): labels of different classes that a linked pair in a bucket joins.

    Of two classes in a bucket one at least is not the largest, so blocks of nodes outside the largest
    meet blocks of all nodes. No pair is a row, and no block grows with its bucket.
    """
    now = members.select("node", "sketch").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(nodes.select("node", "n_grams"), "node")
    held = now.groupBy("sketch", "label").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    sums = F.max(F.struct("n", "grams", "label")).alias("most"), F.sum("n").alias("n"), F.sum("grams").alias("grams")
    mixed = held.groupBy("sketch").agg(*sums, F.count("*").alias("classes")).where("classes > 1")
    blocks = lambda n, grams: F.ceil(F.greatest(n / BLOCK_NODES, grams / BLOCK_GRAMS, F.lit(1.0))).cast("int")
    mixed = mixed.select("sketch", F.col("most.label").alias("largest"), "n", "grams", blocks(F.col("n") - F.col("most.n"), F.col("grams") - F.col("most.grams")).alias("n_a"), blocks(F.col("n"), F.col("grams")).alias("n_b"))
    mixed = materialise(mixed, "mixed")
    small = mixed.where("n_b = 1").agg(F.sum("n"), F.sum("grams")).first()
    packs = max(1, -(-(small[0] or 0) // BLOCK_NODES), -(-(small[1] or 0) // BLOCK_GRAMS))
    pack = F.when(F.col("n_b") == 1, F.pmod(F.xxhash64("sketch"), F.lit(packs))).otherwise(F.col("sketch"))
    rows = now.join(mixed.drop("n", "grams"), "sketch").select("node", "sketch", "label", "n_grams", (F.col("label") != F.col("largest")).alias("asks"), "n_a", "n_b", pack.alias("pack"))
    rows = rows.join(nodes.select("node", "sketches"), "node").join(texts, "node")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["node", "sketch", "label", "n_grams", "sketches", "text", "asks", "pack"]
    a = rows.where("asks").select(*columns, block("n_a").alias("i"), each("n_b").alias("j"))
    b = rows.select(*(F.col(c).alias(c) for c in columns), each("n_a").alias("i"), block("n_b").alias("j"))
    key = "pack", "i", "j"
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(_links_of_block, "a binary, b binary")


def _text_hash() -> F.Column:
    return F.xxhash64(F.lower("text"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, lower-cased text) of the wanted (node, rep, rep_hash), found by doc_id and hash of the text: rows of one id, or without one, stay apart."""
    rows = docs.select("doc_id", F.lower("text").alias("text"), _text_hash().alias("text_hash"))
    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
    return found.select("node", "text").dropDuplicates(["node"])


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, node (null without words), class_id (the least doc_id of the class), class_size (rows)."""
    rows = materialise(docs.select("doc_id", _text_hash().alias("text_hash"), _sketch_of(F.lower("text")).alias("s")).select("doc_id", "text_hash", "s.*"), "sketches")
    of_rep = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("rep_hash")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), of_rep, F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("sketches").alias("sketches"))
    nodes = materialise(nodes, "nodes")
    members = materialise(_buckets(nodes), "buckets")
    texts = materialise(_texts_of(docs, members.select("node").distinct().join(nodes.select("node", "rep", "rep_hash"), "node")), "candidate-texts")
    labels = materialise(connected(_linked(_first_pairs(members, nodes), texts)), "labels")
    more = materialise(_open_links(members, labels, nodes, texts), "links")
    if not more.isEmpty():
        joined = connected(more).select(F.col("node").alias("label"), F.col("label").alias("final"))
        alone = joined.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("final").alias("label"))
        labels = materialise(labels.join(joined, "label", "left").select("node", F.coalesce("final", "label").alias("label")).union(alone), "labels")
    labels = nodes.select("node", "rep", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = labels.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    found = labels.join(heads, "label").select("node", "class_id", "class_size")
    return rows.select("doc_id", "text_hash", "node").join(found, "node", "left").select("doc_id", "text_hash", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the least doc_id, with its columns; rows without words all stay."""
    found = materialise(classes(docs), "classes").where("node is not null")
    # of the rows of a class that hold its least doc_id, one text; a class without doc_ids keeps the text of its least node
    first = F.min(F.when(F.col("doc_id").eqNullSafe(F.col("class_id")), F.struct("node", "text_hash"))).alias("first")
    heads = found.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("node")).alias("own")).agg(first)
    heads = heads.select(F.col("class_id").alias("near·id"), F.col("first.text_hash").alias("near·head"))
    row = docs.select(F.struct("*").alias("near·row"), F.col("doc_id").alias("near·doc"), _text_hash().alias("near·hash"), F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False)).alias("near·words"))
    kept = row.where("`near·words`").join(heads, F.col("near·doc").eqNullSafe(F.col("near·id")) & (F.col("near·hash") == F.col("near·head")), "left_semi")
    if not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["near·doc", "near·hash"])
    return kept.union(row.where("NOT `near·words`")).select("near·row.*")
