"""Spelling variants of a corpus' words, found by bidirectional FM-index search.

Two words are near if one inserted, deleted or replaced code point makes one of the other. Such a
change lies in the left or in the right half of a word, so the other half stands unchanged in both.
The search matches that half exactly, from the delimiter at its end of the word inwards, then extends
over the rest and lets one error pass, keeping the suffix-rank intervals of the delimited vocabulary
and of its mirror in step. Only extensions that some word of the vocabulary really has stay alive.

A word has LEAST code points, so a half has three at least: words meet by their first three code points
(for errors in the right half) and by their last three (left half). Spark deals the vocabulary by
these keys into buckets; a bucket of more than INDEX_POINTS code points or ASKED words, which a common
beginning makes, is cut into blocks of its index side and of its asking side, and each pair of blocks
is one task-sized search. A near pair is found in exactly one place: by its left half if that is
unchanged, else by its right half. So only counts and the best near word leave a task, never pairs.

Defined cases: null and empty texts have no words, a null document id counts as the empty string in
the checksum; ties go to the smaller word in code-point order; words of any length are kept; repeated
documents count as often as they stand; an empty table gives an empty result; other columns, clashing
names included, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.storage import materialise

#: What a word is made of, how one run in so many loses a code point, and the least word.
RUN = "[A-Za-zÀ-ÿ]+"
DELETE_EACH, LEAST, FEWEST, TIMES = 199, 6, 5, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of a block's index and words that ask it at a time, at most (a longer word is a block of its own).
INDEX_POINTS, ASKED = 100_000, 8192
KEY = 3
#: Pairs of blocks in a task.
PAIRS = 2


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of at least LEAST code points with FEWEST occurrences or more."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % DELETE_EACH == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST)


def _rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of a text in order, by doubling the length that is compared. The text must not be periodic."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        both = rank * n + np.roll(rank, -step)
        order = np.argsort(both, kind="stable")
        fresh = np.diff(both[order], prepend=both[order[0]]) != 0
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Index:
    """A vocabulary as one text, each word behind a delimiter (symbol 0), with suffix ranks of the text and of its mirror.

    An interval pair (near, far, size) tells which rotations of the text that is extended (near) and of
    its mirror (far) begin with what has been matched. ``mirrored`` extends to the right, the other to the left.
    """

    def __init__(self, words: list[str]):
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words])
        self.alphabet = np.unique(self.points)
        symbols = np.searchsorted(self.alphabet, self.points) + 1
        starts = np.cumsum(np.concatenate([[0], lengths[:-1] + 1]))
        text = np.zeros(len(symbols) + len(words), np.int64)
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(words)), lengths) + 1] = symbols
        self.n, self.sigma = len(text), len(self.alphabet) + 1
        self.smaller = np.searchsorted(np.sort(text), np.arange(self.sigma))
        order = _rotations(text)
        self.word_of = np.where(text[order] == 0, np.searchsorted(starts, order), -1)
        self.before = {False: self._counts(text[order - 1]), True: self._counts(text[::-1][_rotations(text[::-1]) - 1])}

    def _counts(self, last: np.ndarray) -> np.ndarray:
        """(place, symbol) -> how often the symbol stands before the place in the last column."""
        out = np.zeros((self.n + 1, self.sigma), np.int32)
        out[np.arange(1, self.n + 1), last] = 1
        return np.cumsum(out, axis=0, out=out)

    def symbols(self, words: list[str]) -> np.ndarray:
        """Symbols of all words one after the other; -1 where the index doesn't have the code point."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        place = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == points, place + 1, -1)

    def spread(self, state: np.ndarray, mirrored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each state extended by every symbol: near, far and size, one column a symbol."""
        near, far, size = state
        low, high = self.before[mirrored][near], self.before[mirrored][near + size]
        sizes = (high - low).astype(np.int64)
        return self.smaller + low, far[:, None] + np.cumsum(sizes, axis=1) - sizes, sizes

    def extend(self, state: np.ndarray, symbol: np.ndarray, mirrored: bool) -> np.ndarray:
        """Each state extended by its symbol; size 0 where nothing matches."""
        near, far, sizes = self.spread(state, mirrored)
        row, at = np.arange(len(symbol)), np.maximum(symbol, 0)
        return np.stack([near[row, at], far[row, at], np.where(symbol >= 0, sizes[row, at], 0)])

    def near_words(self, symbols: np.ndarray, at: np.ndarray, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
        """(asking word, word of the index): matches that share the exact half and have one error behind it.

        ``symbols`` has the asking words in the direction of the search, word k from at[k] to at[k + 1];
        the half that comes first is exact.
        """
        lengths = np.diff(at)
        half = lengths // 2 if mirrored else lengths - lengths // 2
        query = np.arange(len(lengths))
        state = np.stack([np.zeros(len(query), np.int64), np.zeros(len(query), np.int64), np.full(len(query), self.n, np.int64)])
        state, place = self.extend(state, np.zeros(len(query), np.int64), mirrored), np.zeros(len(query), np.int64)

        def kept(query: np.ndarray, place: np.ndarray, state: np.ndarray) -> tuple:
            alive = state[2] > 0
            return query[alive], place[alive], state[:, alive]

        strict: list[tuple] = []  # states behind their error
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query) or strict:
            if len(query):
                free = place >= half[query]
                if free.any():
                    strict += self._errors(query[free], place[free], state[:, free], symbols, at, lengths, mirrored)
                go = place < lengths[query]
                query, place, state = query[go], place[go], state[:, go]
                state = self.extend(state, symbols[at[query] + place], mirrored)
                query, place, state = kept(query, place + 1, state)
            if strict:
                q, p, s = (np.concatenate([x[k] for x in strict], axis=-1) for k in range(3))
                ended = p == lengths[q]
                done = self.extend(s[:, ended], np.zeros(int(ended.sum()), np.int64), mirrored)
                hit = done[2] > 0
                # the delimiters at both ends make the match one whole word
                first = done[1] if mirrored else done[0]
                found.append((q[ended][hit], self.word_of[first[hit]]))
                q, p, s = q[~ended], p[~ended], s[:, ~ended]
                strict = [kept(q, p + 1, self.extend(s, symbols[at[q] + p], mirrored))] if len(q) else []
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate([f[0] for f in found]) * (self.n + 1) + np.concatenate([f[1] for f in found]))
        return pairs // (self.n + 1), pairs % (self.n + 1)

    def _errors(self, query, place, state, symbols, at, lengths, mirrored) -> list[tuple]:
        """The states after one error: a code point left out, put in or replaced."""
        near, far, sizes = self.spread(state, mirrored)
        sizes[:, 0] = 0
        row, c = np.nonzero(sizes)
        grown = np.stack([near[row, c], far[row, c], sizes[row, c]])
        inside = place < lengths[query]
        own = np.where(inside, symbols[np.minimum(at[query] + place, max(0, len(symbols) - 1))], -1)
        replaced = inside[row] & (c != own[row])
        out = [(query[row], place[row], grown), (query[row][replaced], place[row][replaced] + 1, grown[:, replaced]), (query[inside], place[inside] + 1, state[:, inside])]
        return [x for x in out if len(x[0])]


_NEAR = "word string, n_near long, best struct<minus_n:long,word:string>"


def _search(asked: pa.Table, index: pa.Table) -> pa.Table:
    """For each asking word its near words in the index: how many, and the best."""
    words, counts = index.column("word").to_pylist(), index.column("n").to_numpy()
    asking = asked.column("word").to_pylist()
    mirrored = bool(index.column("side")[0].as_py() == 0) if len(index) else True
    if not words or not asking:
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best": pa.array([], pa.struct([("minus_n", pa.int64()), ("word", pa.string())]))})
    held = Index(words)
    symbols = held.symbols(asking if mirrored else [w[::-1] for w in asking])
    query, of = held.near_words(symbols, np.cumsum([0, *map(len, asking)]), mirrored)
    best: dict[int, list] = {}
    for q, k in zip(query.tolist(), of.tolist(), strict=True):
        if not mirrored and words[k].startswith(asking[q][: len(asking[q]) // 2]):
            continue  # found by its left half
        this = (-int(counts[k]), words[k])
        if q not in best:
            best[q] = [1, this]
        else:
            best[q][0] += 1
            best[q][1] = min(best[q][1], this)
    return pa.table({
        "word": pa.array([asking[q] for q in best], pa.string()), "n_near": pa.array([x[0] for x in best.values()], pa.int64()),
        "best": pa.array([{"minus_n": x[1][0], "word": x[1][1]} for x in best.values()], pa.struct([("minus_n", pa.int64()), ("word", pa.string())])),
    })


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of each word of (word, n) that has a near word: how many, and the one of largest n."""
    points = words.agg(F.sum(F.length("word") + 1).cast("long")).first()[0] or 0
    buckets = max(1, -(-4 * points // INDEX_POINTS))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, KEY).alias("key")), F.struct(F.lit(1).alias("side"), F.expr(f"right(word, {KEY})").alias("key")))
    dealt = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.side", F.pmod(F.xxhash64("s.side", "s.key"), F.lit(buckets)).alias("bucket"))
    sizes = dealt.groupBy("side", "bucket").agg(F.ceil(F.sum(F.length("word") + 1) / INDEX_POINTS).cast("int").alias("n_c"), F.ceil(F.count("*") / ASKED).cast("int").alias("n_q"))
    dealt = dealt.join(sizes, ["side", "bucket"])
    block = lambda n, seed: F.pmod(F.xxhash64("word", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = "side", "bucket", "qb", "cb"
    own = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  each side of the cogroup has columns of its own
    asked = dealt.select(*own("side", "bucket", "word"), block("n_q", 1).alias("qb"), each("n_c").alias("cb"))
    index = dealt.select(*own("side", "bucket", "word", "n"), each("n_q").alias("qb"), block("n_c", 2).alias("cb"))
    # a pair of blocks is little data and much work, so tasks are counted by pairs, not by bytes
    tasks = max(1, -(-(sizes.agg(F.sum(F.col("n_c") * F.col("n_q"))).first()[0] or 0) // PAIRS))
    found = asked.repartition(tasks, *key).groupBy(*key).cogroup(index.repartition(tasks, *key).groupBy(*key)).applyInArrow(_search, _NEAR)
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.minus_n")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form (word, form). Each round doubles the way that is followed; a form is TIMES as frequent, so ways are short."""
    roots = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary."""
    words = materialise(vocabulary(docs, key, text), "vocabulary")
    found = materialise(near(words), "near-words")
    taken = F.col("near_n") >= TIMES * F.col("n")
    rows = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n"))
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
