"""A kept full-text index with positions: blocks of postings, read only where a query can need them.

Documents are dealt by falling length into zones of up to ZONE neighbours. A block holds the postings of
one token in one zone: keys, groups (tenants), counts, positions (those of all its documents in one list),
and the greatest count. A file holds whole zones in order of token, so a query reads the row groups of its
tokens and a common token is spread over all files. Added documents make further zones in a folder of
their own.

A batch of queries within a checked bound is sent to all tasks. The blocks of its tokens are dealt by zone;
a task takes zone after zone, keeps the k best documents of each query and hands on only those, so no
pair of a query and a document is ever a row. Queries whose bound in a zone stays below their k-th score
so far are left out there. A larger batch goes through joins:

Ranking by matches adds up the greatest counts of a query's blocks in a zone, which bounds every score
there; zones of long documents come first, and zones whose bound stays below the k-th score found there
are not read. Ranking by cover density reads the zones that hold all tokens of an alternative, and only
there positions.

Texts are lower-cased; tokens are runs of ASCII letters, digits and underscores; stop words keep their
place but have no postings; null texts have none; documents of equal key count together; a query
without terms finds nothing; ties go by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.operators import fulltext
from tidemark.operators.topk import Best, ranked, sent
from tidemark.sources.shared import materialise

#: Documents of a zone, and zones a query that are read before any is pruned.
ZONE, FIRST = 256, 2
#: Documents of a file, about.
PART = 2048
#: A zone's number holds the partition and the place in it.
_PLACE = 28
BLOCK = "token string, zone long, n int, best int, keys array<long>, groups array<long>, tfs array<int>, spots array<int>"


def _blocks(zone: int, keys: pa.Array, groups: pa.Array, texts: pa.Array, stem: bool) -> pa.RecordBatch:
    """The blocks of one zone's lower-cased texts."""
    flat, doc = fulltext.split(texts)
    spot = np.arange(len(doc)) - np.searchsorted(doc, doc)
    coded = flat.dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    stops = set(fulltext.STOP_WORDS)
    names = sorted({fulltext.stem(w) if stem else w for w in words if w not in stops})
    place = {w: k for k, w in enumerate(names)}
    to = np.array([-1 if w in stops else place[fulltext.stem(w) if stem else w] for w in words], np.int64)
    code = to[code] if len(words) else code
    kept = code >= 0
    code, doc, spot = code[kept], doc[kept], spot[kept]
    order = np.argsort(code.astype(np.uint16) if len(names) < 1 << 16 else code, kind="stable")  # tokens come by document and place
    code, doc, spot = code[order], doc[order], spot[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (np.diff(code) != 0) | (np.diff(doc) != 0)
    pair = np.flatnonzero(fresh)
    tf = np.diff(np.append(pair, len(code)))
    at = np.searchsorted(code[pair], np.arange(len(names) + 1))
    outer, own = pa.array(at, pa.int32()), pa.array(doc[pair])
    spots = pa.ListArray.from_arrays(pa.array(np.append(pair, len(code))[at], pa.int32()), pa.array(spot, pa.int32()))
    best = np.maximum.reduceat(tf, at[:-1]) if len(names) else np.zeros(0, np.int64)
    columns = [
        pa.array(names, pa.string()), pa.array(np.full(len(names), zone), pa.int64()), pa.array(np.diff(at), pa.int32()), pa.array(best, pa.int32()),
        pa.ListArray.from_arrays(outer, keys.take(own)), pa.ListArray.from_arrays(outer, groups.take(own)), pa.ListArray.from_arrays(outer, pa.array(tf, pa.int32())), spots,
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK.split(", ")])


def build(corpus: DataFrame, group: str | None = None, stem: bool = False) -> DataFrame:
    """The blocks of ``corpus`` (key, text, and the group column), in order of token and zone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ZONE):
                part = batch.slice(at, ZONE)
                yield _blocks(part.column(0)[0].as_py() << _PLACE | n, *part.columns[1:], stem)
                n += 1

    rows = corpus.select(F.col("key").cast("long").alias("key"), (F.col(group) if group else F.lit(0)).cast("long").alias("g"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    parts = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-corpus.count() // PART))
    dealt = rows.repartitionByRange(parts, F.desc("size"), "key").sortWithinPartitions(F.desc("size"), "key", "text")
    found = dealt.select(F.spark_partition_id().cast("long").alias("part"), "key", "g", F.lower("text").alias("text")).mapInArrow(run, BLOCK)
    return found.sortWithinPartitions("token", "zone")


class KeptIndex:
    """An index in a folder that all executors see; each ``append`` writes a generation of its own."""

    def __init__(self, spark: SparkSession, folder: str, stem: bool = False):
        self.spark, self.folder, self.stem = spark, folder.rstrip("/"), stem

    def append(self, corpus: DataFrame, generation: int, group: str | None = None) -> KeptIndex:
        """Adds documents; written again under the same number, a generation that was cut off is replaced."""
        build(corpus, group, self.stem).write.mode("overwrite").parquet(f"{self.folder}/generation={generation}")
        return self

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"{BLOCK}, generation int").parquet(self.folder)

    def search(self, queries: DataFrame, k: int = fulltext.K, mode: str = "any", same_tenant: bool = False) -> DataFrame:
        """(query_id, key, hits, rank) as ``fulltext.search``; terms are stemmed if the index is."""
        if self.stem:
            queries = fulltext.stemmed_terms(queries)
        return search(queries, self.blocks(), k, mode, same_tenant)

    def cover(self, queries: DataFrame, k: int = fulltext.K, same_tenant: bool = False) -> DataFrame:
        """(query_id, key, score, rank) by ``cover``; ``queries`` has query_id and text (and tenant_id)."""
        return cover(queries, self.blocks(), k, same_tenant, self.stem)


def _small(rows: DataFrame) -> DataFrame:
    """The rows, to be broadcast if they are few (a checked bound)."""
    got = sent(rows)
    return rows if got is None else F.broadcast(rows.sparkSession.createDataFrame(got, rows.schema))


_ZONE = ["generation", "zone"]


def bounds(asked: DataFrame, blocks: DataFrame, every: bool) -> DataFrame:
    """(query_id, generation, zone, n_blocks, bound): what no score of the query in the zone exceeds. every: zones that lack a term are left out."""
    found = blocks.select("token", *_ZONE, "best").join(asked, "token").groupBy("query_id", *_ZONE).agg(F.count("*").alias("n_blocks"), F.sum("best").alias("bound"), F.first("n_terms").alias("n_terms"))
    return (found.where("n_blocks = n_terms") if every else found).drop("n_terms")


def _scores(zones: DataFrame, asked: DataFrame, blocks: DataFrame, every: bool, same_tenant: bool) -> DataFrame:
    """(query_id, key, hits) of all documents with a term in the zones."""
    wanted = _small(zones.select("query_id", *_ZONE)).join(asked, "query_id")
    rows = blocks.select("token", *_ZONE, "keys", "groups", "tfs").join(_small(wanted), ["token", *_ZONE])
    rows = rows.select("query_id", "g", "n_terms", "token", F.explode(F.arrays_zip("keys", "groups", "tfs")).alias("p"))
    if same_tenant:
        rows = rows.where(F.col("p.groups") == F.col("g"))
    found = rows.groupBy("query_id", F.col("p.keys").alias("key")).agg(F.sum("p.tfs").alias("hits"), F.count_distinct("token").alias("n_found") if every else F.lit(0).alias("n_found"), F.first("n_terms").alias("n_terms"))
    return (found.where("n_found = n_terms") if every else found).select("query_id", "key", "hits")


def chosen(asked: DataFrame, blocks: DataFrame, k: int, every: bool, same_tenant: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all zones with a bound and their order, scores in the first zones of each query, the further zones that can hold one of the k best)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), *_ZONE)
    zones = materialise(bounds(asked, blocks, every).withColumn("place", F.row_number().over(order)), "zones")
    first = materialise(_scores(zones.where(F.col("place") <= FIRST), asked, blocks, every, same_tenant), "first-zones")
    least = ranked(first, "hits", k).where(F.col("rank") == k).select("query_id", F.col("hits").alias("least"))
    rest = zones.where(F.col("place") > FIRST).join(least, "query_id", "left").where("least IS NULL OR bound >= least").drop("least")
    return zones, first, rest


def search(queries: DataFrame, blocks: DataFrame, k: int = fulltext.K, mode: str = "any", same_tenant: bool = False) -> DataFrame:
    """(query_id, key, hits, rank): the k keys with most matching tokens, ties by key; mode "all" asks for every term.

    A document of several rows lies in several zones, and then bounds are not those of its sum: keys are
    expected to be unique in an index.
    """
    every = mode == "all"
    group = F.col("tenant_id").cast("long") if same_tenant else F.lit(0).cast("long")
    queries = queries.select("query_id", group.alias("g"), F.array_distinct("terms").alias("terms"))
    rows = sent(queries, fulltext.TERM_ROWS)
    if rows is not None:
        return ranked(_zonewise(rows, blocks, k, every, same_tenant), "hits", k).select("query_id", "key", "hits", "rank")
    asked = materialise(queries.select("query_id", "g", F.size("terms").alias("n_terms"), F.explode("terms").alias("token")), "asked")
    asked = _small(asked)
    _, first, rest = chosen(asked, blocks, k, every, same_tenant)
    found = first.unionByName(_scores(rest, asked, blocks, every, same_tenant))
    return ranked(found, "hits", k).select("query_id", "key", "hits", "rank")


def _by_zone(blocks: DataFrame, tokens: pa.Table, *columns: str) -> DataFrame:
    """The blocks of the tokens, each zone in one task, zones of long documents first."""
    spark = blocks.sparkSession
    found = blocks.select(*_ZONE, "token", *columns).join(F.broadcast(spark.createDataFrame(tokens, "token string")), "token", "left_semi")
    # a zone's number holds its rank by length above, by which a task takes its zones in turn
    return found.select(*_ZONE, "token", *columns).repartition(*_ZONE).sortWithinPartitions("zone", "generation")


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each zone, of batches in order of zone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        zone, generation = batch.column("zone").to_numpy(), batch.column("generation").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(zone) != 0) | (np.diff(generation) != 0)) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z > a:
                if held and (held[-1].column("zone")[0], held[-1].column("generation")[0]) != (batch.column("zone")[a], batch.column("generation")[a]):
                    yield pa.concat_batches(held)
                    held = []
                held.append(batch.slice(a, z - a))
    if held:
        yield pa.concat_batches(held)


def _documents(zone: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, groups; block and document of each posting) of a zone; a group that is null is -1."""
    block = pc.list_parent_indices(zone.column("keys")).to_numpy()
    keys, first, doc = np.unique(pc.list_flatten(zone.column("keys")).to_numpy(), return_index=True, return_inverse=True)
    groups = pc.list_flatten(zone.column("groups")).fill_null(-1).to_numpy()[first]
    return keys, groups, block, doc


def _zonewise(asked: pa.Table, blocks: DataFrame, k: int, every: bool, same_tenant: bool) -> DataFrame:
    """(query_id, key, hits): for each query (query_id, g, terms) the k best documents of each task's zones."""
    vocabulary = pa.table({"token": fulltext.Terms(asked).vocabulary})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = fulltext.Terms(asked)
        best = Best(len(terms.ids), k)
        for zone in _zones(batches):
            keys, groups, block, doc = _documents(zone)
            code = pc.index_in(zone.column("token"), terms.vocabulary).to_numpy()
            tf = pc.list_flatten(zone.column("tfs")).to_numpy()
            terms.meet(code.astype(np.int64)[block], doc, tf, keys, groups if same_tenant else np.zeros(len(keys), np.int64), every, best)
        yield pa.RecordBatch.from_arrays(terms.found(best), ["query_id", "key", "hits"])

    return _by_zone(blocks, vocabulary, "keys", "groups", "tfs").mapInArrow(run, "query_id long, key long, hits long")


#: An alternative of a query is a list of units; a unit is a word or a phrase, its words with their place in it.
UNITS = "array<struct<alternative:int,unit:int,negated:boolean,words:array<struct<token:string,place:int>>>>"


def parse(query: Column) -> Column:
    """A typed query as units: words and "quoted phrases" all asked for, each negated by a leading -, ``or`` between alternatives.

    Stop words are not asked for, but keep their place in a phrase. Words of several tokens are phrases.
    """
    parts = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))
    said = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("alternative"), F.array().cast("array<struct<alternative:int,part:string>>").alias("parts")),
        lambda a, p: F.struct(
            (a["alternative"] + (p == "or").cast("int")).alias("alternative"),
            F.when(p == "or", a["parts"]).otherwise(F.array_append(a["parts"], F.struct(a["alternative"].alias("alternative"), p.alias("part")))).alias("parts"),
        ),
        lambda a: a["parts"],
    )
    stops = F.array(*map(F.lit, fulltext.STOP_WORDS))

    def unit(x: Column, i: Column) -> Column:
        words = F.regexp_extract_all(x["part"], F.lit("[a-z0-9_]+"), F.lit(0))
        placed = F.filter(F.transform(words, lambda w, k: F.struct(w.alias("token"), k.alias("place"))), lambda w: ~F.array_contains(stops, w["token"]))
        return F.struct(x["alternative"].alias("alternative"), i.alias("unit"), x["part"].startswith("-").alias("negated"), placed.alias("words"))

    return F.filter(F.transform(said, unit), lambda u: F.size(u["words"]) > 0).cast(UNITS)


def spans(units: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The minimal spans that hold an occurrence (first, last) of every unit, in one sweep over the ends of the occurrences."""
    latest: list[int | None] = [None] * len(units)
    out: list[tuple[int, int]] = []
    for last, k, first in sorted((last, k, first) for k, found in enumerate(units) for first, last in found):
        latest[k] = first if latest[k] is None else max(latest[k], first)
        if None in latest:
            continue
        begin = min(latest)
        if not out or begin > out[-1][0]:
            if out and out[-1][1] == last:
                out.pop()
            out.append((begin, last))
    return out


def density(units: list[dict], spots: dict[str, list[int]]) -> float:
    """The cover density of a document, given the positions of a query's tokens in it: each minimal span that satisfies the query adds 1 / (1 + words in it that the query doesn't ask for). 0 if it doesn't match."""
    alternatives: dict[int, list[dict]] = {}
    for u in units:
        alternatives.setdefault(u["alternative"], []).append(u)
    found: list[tuple[int, int]] = []
    for own in alternatives.values():
        occurrences, matches = [], True
        for u in own:
            shift = u["words"][0]["place"]
            starts = reduce(set.intersection, ({p - w["place"] + shift for p in spots.get(w["token"], ())} for w in u["words"]))
            if bool(starts) == u["negated"]:
                matches = False
                break
            if not u["negated"]:
                length = u["words"][-1]["place"] - shift
                occurrences.append([(s, s + length) for s in starts])
        if matches and occurrences:
            found += spans(occurrences)
    asked = sorted({p for u in units if not u["negated"] for w in u["words"] for p in spots.get(w["token"], ())})
    asked_at = np.array(asked)
    total, begun = 0.0, None
    for first, last in sorted(set(found), key=lambda s: (-s[0], s[1])):  # a span that holds another one is not minimal
        if begun is not None and last >= begun:
            continue
        begun = last
        noise = (last - first + 1) - int(np.searchsorted(asked_at, last, "right") - np.searchsorted(asked_at, first))
        total += 1 / (1 + noise)
    return total


class _Zone:
    """The documents of a zone, with all positions of a batch's tokens as numbers that rise by document and place."""

    def __init__(self, zone: pa.RecordBatch, margin: int):
        self.keys, self.groups, block, doc = _documents(zone)
        spots, self.margin = pc.list_flatten(zone.column("spots")).to_numpy().astype(np.int64), margin
        #: From one document to the next; a phrase's first place lies at most ``margin`` before its words.
        self.step = (int(spots.max()) if len(spots) else 0) + 2 * margin + 2
        tf = pc.list_flatten(zone.column("tfs")).to_numpy()
        at = np.repeat(doc, tf) * self.step + margin + spots
        of = np.repeat(block, tf)
        cuts = np.searchsorted(of, np.arange(zone.num_rows + 1))
        self.at = {w: at[cuts[i] : cuts[i + 1]] for i, w in enumerate(zone.column("token").to_pylist())}
        self.of_unit: dict[tuple, np.ndarray] = {}

    def starts(self, words: tuple[tuple[str, int], ...]) -> np.ndarray:
        """Where a unit's first word stands, in order."""
        if words not in self.of_unit:
            shift, found = words[0][1], None
            for token, place in words:
                at = self.at.get(token)
                if at is None:
                    found = np.zeros(0, np.int64)
                    break
                at = np.unique(at) - (place - shift)
                found = at if found is None else found[np.isin(found, at, assume_unique=True)]
            self.of_unit[words] = found
        return self.of_unit[words]

    def spans(self, units: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
        """``spans`` of all documents at once: (first, last) of units given as their starts and length less one."""
        ends = np.unique(np.concatenate([at + n for at, n in units]))
        begin, whole = ends, np.ones(len(ends), bool)
        for at, n in units:  # the latest occurrence that ends there or before
            i = np.searchsorted(at + n, ends, "right") - 1
            latest = at[np.maximum(i, 0)]
            whole &= (i >= 0) & (latest // self.step == ends // self.step)
            begin = np.minimum(begin, latest)
        begin, ends = begin[whole], ends[whole]
        fresh = np.ones(len(begin), bool)
        fresh[1:] = begin[1:] > begin[:-1]
        return begin[fresh], ends[fresh]

    def density(self, alternatives: list[tuple[list, list]], asked: list[str], allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, their ``density``) of a query: for each alternative its units and negated units, and all words it asks for."""
        firsts, lasts = [], []
        for wanted, negated in alternatives:
            if not wanted or any(token not in self.at for unit in wanted for token, _ in unit):
                continue
            units = [(self.starts(unit), unit[-1][1] - unit[0][1]) for unit in wanted]
            if not all(len(at) for at, _ in units):
                continue
            first, last = self.spans(units)
            out = [at for unit in negated if len(at := self.starts(unit))]
            if out:
                kept = ~np.isin(first // self.step, np.concatenate(out) // self.step)
                first, last = first[kept], last[kept]
            firsts.append(first)
            lasts.append(last)
        if not firsts:
            return np.zeros(0, np.int64), np.zeros(0)
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        if allowed is not None:
            own = allowed[first // self.step]
            first, last = first[own], last[own]
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0)
        order = np.lexsort((last, -first))  # a span that holds another one is not minimal
        first, last = first[order], last[order]
        kept = np.ones(len(first), bool)
        kept[1:] = last[1:] < np.minimum.accumulate(last)[:-1]
        first, last = first[kept], last[kept]
        words = np.unique(np.concatenate([self.at[w] for w in asked if w in self.at]))
        noise = last - first + 1 - (np.searchsorted(words, last, "right") - np.searchsorted(words, first))
        docs, of = np.unique(first // self.step, return_inverse=True)
        return docs, np.bincount(of, 1 / (1 + noise))


def _covered(asked: pa.Table, blocks: DataFrame, k: int, same_tenant: bool) -> DataFrame:
    """(query_id, key, score): for each parsed query (query_id, g, units) the k best documents of each task's zones by cover density."""
    ids, groups, parsed, margin = [], [], [], 0
    for row in asked.to_pylist():
        alternatives: dict[int, tuple[list, list]] = {}
        for u in row["units"] or ():
            words = tuple((w["token"], w["place"]) for w in u["words"])
            alternatives.setdefault(u["alternative"], ([], []))[u["negated"]].append(words)
            margin = max(margin, words[-1][1])
        if alternatives and row["g"] is not None:
            ids.append(row["query_id"])
            groups.append(row["g"])
            parsed.append((list(alternatives.values()), sorted({t for wanted, _ in alternatives.values() for unit in wanted for t, _ in unit})))
    vocabulary = pa.table({"token": pa.array(sorted({t for alternatives, _ in parsed for both in alternatives for units in both for unit in units for t, _ in unit}), pa.string())})
    numbers = np.array(ids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(parsed), k)
        for rows in _zones(batches):
            zone = _Zone(rows, margin)
            for q, (alternatives, words) in enumerate(parsed):
                docs, score = zone.density(alternatives, words, zone.groups == groups[q] if same_tenant else None)
                if len(docs):
                    best.add(np.full(len(docs), q), np.round(score, 9), zone.keys[docs])
        yield pa.RecordBatch.from_arrays([pa.array(numbers[best.query], pa.int64()), pa.array(best.key, pa.int64()), pa.array(best.value, pa.float64())], ["query_id", "key", "score"])

    return _by_zone(blocks, vocabulary, "keys", "groups", "tfs", "spots").mapInArrow(run, "query_id long, key long, score double")


def cover(queries: DataFrame, blocks: DataFrame, k: int = fulltext.K, same_tenant: bool = False, stem: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the k documents that match a typed query (query_id, text, and tenant_id), by cover density.

    A batch within a checked bound is sent to the zones (``_covered``). For a larger one zones are taken whose
    blocks hold every word that an alternative asks for, then documents that do; only their positions are
    gathered, a row for each query and document.
    """
    group = F.col("tenant_id").cast("long") if same_tenant else F.lit(0).cast("long")
    parsed = queries.select("query_id", group.alias("g"), parse(F.col("text")).alias("units"))
    if stem:
        parsed = _stemmed_units(parsed)
    rows = sent(parsed)
    if rows is not None:
        return ranked(_covered(rows, blocks, k, same_tenant), "score", k).select("query_id", "key", "score", "rank")
    parsed = materialise(parsed, "parsed")
    unit = parsed.select("query_id", "g", F.explode("units").alias("u"))
    words = unit.select("query_id", "g", "u.alternative", "u.negated", F.explode("u.words.token").alias("token")).distinct()
    needed = words.where("NOT negated").select("query_id", "g", "alternative", "token")
    needed = _small(materialise(needed.join(needed.groupBy("query_id", "alternative").agg(F.count("*").alias("n_words")), ["query_id", "alternative"]), "needed"))
    heads = blocks.select("token", *_ZONE).join(needed, "token")
    zones = heads.groupBy("query_id", "alternative", "n_words", *_ZONE).agg(F.count("*").alias("n")).where("n = n_words").select("query_id", "alternative", *_ZONE)
    zones = materialise(zones, "cover-zones")
    wanted = _small(materialise(_small(zones).join(needed, ["query_id", "alternative"]), "cover-blocks"))
    held = blocks.select("token", *_ZONE, "keys", "groups").join(wanted, ["token", *_ZONE]).select("query_id", "alternative", "g", "n_words", "token", *_ZONE, F.explode(F.arrays_zip("keys", "groups")).alias("p"))
    if same_tenant:
        held = held.where(F.col("p.groups") == F.col("g"))
    keys = held.groupBy("query_id", "alternative", "n_words", *_ZONE, F.col("p.keys").alias("key")).agg(F.count_distinct("token").alias("n")).where("n = n_words")
    keys = materialise(keys.select("query_id", *_ZONE, "key").distinct(), "cover-keys")
    # positions of all words of the query in these documents, negated ones too
    pairs = _small(materialise(keys.select("query_id", *_ZONE).distinct().join(words.select("query_id", "token").distinct(), "query_id"), "cover-pairs"))
    own = F.transform("tfs", lambda n, i: F.struct(F.get("keys", i).alias("keys"), F.slice("spots", F.get("begin", i) + 1, n).alias("spots")))
    begin = F.aggregate("tfs", F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    lists = blocks.select("token", *_ZONE, "keys", "tfs", "spots").join(pairs, ["token", *_ZONE]).withColumn("begin", begin).select("query_id", "token", *_ZONE, F.explode(own).alias("p"))
    lists = lists.select("query_id", "token", *_ZONE, F.col("p.keys").alias("key"), F.col("p.spots").alias("spots")).join(keys, ["query_id", *_ZONE, "key"], "left_semi")
    rows = lists.groupBy("query_id", "key").agg(F.collect_list(F.struct("token", "spots")).alias("held")).join(_small(parsed.select("query_id", "units")), "query_id")

    @F.arrow_udf(T.DoubleType())
    def score(units: pa.Array, held: pa.Array) -> pa.Array:
        out = []
        for u, h in zip(units, held, strict=True):
            spots: dict[str, list[int]] = {}
            for x in h.as_py():
                spots.setdefault(x["token"], []).extend(x["spots"])
            out.append(density(u.as_py(), spots))
        return pa.array(out, pa.float64())

    found = rows.select("query_id", "key", F.round(score("units", "held"), 9).alias("score")).where("score > 0")
    return ranked(found, "score", k).select("query_id", "key", "score", "rank")


def _stemmed_units(parsed: DataFrame) -> DataFrame:
    kind = parsed.schema["units"].dataType

    @F.arrow_udf(kind)
    def stems(units: pa.Array) -> pa.Array:
        rows = units.to_pylist()
        for row in rows:
            for u in row or ():
                for w in u["words"]:
                    w["token"] = fulltext.stem(w["token"])
        return pa.array(rows, units.type)

    return parsed.withColumn("units", stems("units"))
