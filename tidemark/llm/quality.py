"""Quality rules as weak supervision.

Each rule votes good or bad on a text, or abstains. Expectation-maximisation over the counts of vote
patterns estimates how each rule votes on good and on poor texts, without labels; a text is kept if
the posterior probability that it is good reaches one half. Two hard rules stand before the votes.

Spark counts the patterns over all texts; the driver sees at most 3^rules pattern counts, however
many texts there are. Votes are recomputed from the text where a verdict is needed, so a filter
needs no shuffle of texts.

Defined cases: a null text counts as empty and fails the hard rules; repeated rows and ties get equal
verdicts; an empty table gives an empty result; other columns, clashing names included, pass through
``filter_documents`` untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import wordhash as W
from tidemark.llm.storage import materialise

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: EM stops after so many rounds, or when no probability moves by more than TOLERANCE.
ROUNDS, TOLERANCE = 100, 1e-7
#: Pseudo-counts that keep a rule's rates off 0 and 1, and the share of good texts expected at first.
PSEUDO, GOOD_SHARE = 2.0, 0.85

_SYMBOL, _LETTER, _UPPER, _END = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_UPPER[0x41:0x5B] = True
_END[list(b".,;:!?")] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_letters", "n_symbol_words", "n_bare_words", "n_ended", "n_shout")
SHAPE = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each owner."""
    if not len(keys):
        return np.zeros(n, np.int64)
    key = keys ^ W.mix(owner.astype(np.uint64) + W.U64(1))
    order = np.argsort(key)
    fresh = np.ones(len(key), bool)
    fresh[1:] = np.diff(key[order]) != 0
    return np.bincount(owner[order][fresh], minlength=n)


def _repeat_words(w: W.Words, n: int) -> np.ndarray:
    """Words in a WINDOW-word window that stands twice or more in its text."""
    at, gram = W.grams(w, WINDOW, short=False)
    if not len(at):
        return np.zeros(n, np.int64)
    key = gram ^ W.mix(w.doc[at].astype(np.uint64) + W.U64(1))
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    return W.per_text((np.cumsum(step[:-1]) > 0).astype(np.int64), w.word_at)


def _dup_lines(data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of the text."""
    n = len(text_at) - 1
    first, end = W.runs(data != 0x0A, text_at)
    if not len(first):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(W.NOT_WHITE[data], out=solid[1:])
    worded = solid[end] > solid[first]
    first, end = first[worded], end[worded]
    owner = np.searchsorted(text_at, first, "right") - 1
    lines = np.bincount(owner, minlength=n)
    return lines, lines - _distinct(W.span_hashes(data, first, end), owner, n)


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """The COUNTS of each text."""
    out: list[list[np.ndarray]] = [[] for _ in COUNTS]
    for _, data, text_at in W.slices(texts):
        n = len(text_at) - 1
        w = W.words(data, text_at, W.NOT_WHITE)
        lines, dup_lines = _dup_lines(data, text_at)
        of = lambda flags: W.per_text(flags[data], text_at)
        by_word = lambda flags: W.per_text(flags, w.word_at)
        within = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[data])])[np.stack([w.first, w.end])], axis=0)[0] if len(w.first) else np.zeros(0, np.int64)
        symbols, letters, upper = within(_SYMBOL), within(_LETTER), within(_UPPER)
        last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
        started = (data & 0xC0) != 0x80  # first byte of a character
        row = (
            np.diff(w.word_at), W.per_text(started & W.NOT_WHITE[data], text_at), of(_SYMBOL), dup_lines, _repeat_words(w, n), lines, _distinct(w.hashes, w.doc, n),
            of(_UPPER), of(_LOWER), W.per_text(started & _LETTER[data], text_at), by_word(symbols > 0), by_word(letters == 0), by_word(_END[last]), by_word((upper >= 2) & (upper * 2 >= w.end - w.first)),
        )
        for kept, values in zip(out, row, strict=True):
            kept.append(values)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


@F.arrow_udf(SHAPE)
def _counts_of(texts: pa.Array) -> pa.Array:
    found = text_counts(texts)
    W.give_back()
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], COUNTS)


def _rules() -> dict[str, tuple]:
    """name: (good if, bad if); neither: the rule abstains. Shares are of words where not said otherwise."""
    c = F.col
    share = lambda x: F.try_divide(c(x), c("n_words"))
    cased = c("n_upper") + c("n_lower")
    mean = F.try_divide(c("word_chars"), c("n_words"))
    return {
        "length": (c("n_words") >= 50, c("n_words") < MIN_WORDS),
        "word_length": (mean.between(3, 10), (mean < 2) | (mean > 15)),
        "symbols": (share("n_symbols") < 0.03, share("n_symbols") > 0.1),
        "symbol_words": (share("n_symbol_words") < 0.03, share("n_symbol_words") > 0.1),
        "letters": (c("n_letters") > 0.9 * c("word_chars"), c("n_letters") < 0.8 * c("word_chars")),
        "bare_words": (share("n_bare_words") < 0.05, share("n_bare_words") > 0.15),
        "repeats": (share("n_repeat_words") < 0.05, share("n_repeat_words") > 0.2),
        "lines": ((c("n_lines") > 1) & (c("n_dup_lines") == 0), c("n_dup_lines") > 0.25 * c("n_lines")),
        "variety": (c("n_distinct") > 4 * F.sqrt("n_words"), c("n_distinct") < 2 * F.sqrt("n_words")),
        "case": (c("n_upper") < 0.2 * cased, c("n_upper") > 0.5 * cased),
        "shouting": (share("n_shout") < 0.05, share("n_shout") > 0.3),
        "punctuation": (share("n_ended").between(0.02, 0.4), share("n_ended") > 0.6),
    }


def _pattern() -> F.Column:
    """One letter a rule: g, b, or - if it abstains or the counts are too small to tell."""
    vote = lambda good, bad: F.when(bad, "b").when(good, "g").otherwise("-")
    return F.concat(*(vote(*x) for x in _rules().values()))


def _failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit(counted: dict[str, int]) -> dict[str, float]:
    """Posterior probability of "good" for each vote pattern, by EM over the pattern counts.

    Model: two classes; given the class, rules vote independently. The start is a plain vote in which
    two bad votes outweigh the rest; pseudo-counts keep each rule better than chance at the start.
    """
    if not counted:
        return {}
    patterns = sorted(counted)
    n = np.array([counted[p] for p in patterns], float)
    votes = np.array([[(v == "g") - (v == "b") for v in p] for p in patterns])
    good, bad = votes > 0, votes < 0
    q = 1 / (1 + np.exp(4.0 * bad.sum(1) - 6.0))  # 0 bad votes: 0.998; one: 0.88; two: 0.12
    before = None
    for _ in range(ROUNDS):
        share = (n @ q + PSEUDO * GOOD_SHARE) / (n.sum() + PSEUDO)
        rates = []
        for weight, right in ((n * q, good), (n * (1 - q), bad)):
            cast = weight @ (good | bad)
            rates.append((weight @ right + PSEUDO * 0.7) / (cast + PSEUDO))
        of_good, of_bad = (np.clip(r, 1e-4, 1 - 1e-4) for r in rates)  # each rule's accuracy on either class
        of_bad = np.maximum(of_bad, 1 - of_good)  # a bad vote never speaks for a text
        log_good = math.log(share) + good @ np.log(of_good) + bad @ np.log(1 - of_good)
        log_bad = math.log(1 - share) + good @ np.log(1 - of_bad) + bad @ np.log(of_bad)
        q = 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))
        if before is not None and np.abs(q - before).max() < TOLERANCE:
            break
        before = q
    return dict(zip(patterns, q.tolist(), strict=True))


def _with_posterior(df: DataFrame, posterior: dict[str, float], pattern: str, to: str) -> DataFrame:
    """Attach each pattern's posterior: a broadcast join with at most 3^rules rows (as many as patterns were seen)."""
    seen = df.sparkSession.createDataFrame(list(posterior.items()), f"`{pattern}` string, `{to}` double")
    return df.join(F.broadcast(seen), pattern, "left")


def score(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with its counts, ``base_failed``, ``posterior`` and ``kept``."""
    rows = docs.select(*keep, _counts_of("text").alias("counts")).select(*keep, "counts.*")
    rows = materialise(rows.withColumns({"votes": _pattern(), "base_failed": _failed()}), "quality")
    counted = {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    return _with_posterior(rows, fit(counted), "votes", "posterior").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows whose text is kept, with their columns."""
    q = "quality·"  # names that no table brings along
    rows = docs.select(F.struct("*").alias(f"{q}row"), _counts_of("text").alias(f"{q}counts")).select(f"`{q}row`", f"`{q}counts`.*")
    rows = materialise(rows.select(f"`{q}row`", _pattern().alias(f"{q}votes"), _failed().alias(f"{q}failed")), "quality-rows")
    posterior = fit({r[0]: r["n"] for r in rows.groupBy(f"`{q}votes`").agg(F.count("*").alias("n")).collect()})
    rows = _with_posterior(rows, posterior, f"{q}votes", f"{q}good").where(~F.col(f"`{q}failed`") & (F.col(f"`{q}good`") >= 0.5))
    return rows.select(f"`{q}row`.*")
