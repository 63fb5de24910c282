"""A quality classifier that lets the nearest labelled documents vote in a latent-semantic space.

A text becomes a bag of hashed terms: its byte trigrams, and a few terms that say how much of it
repeats, shouts or is made of symbols. Counts are damped by a logarithm and weighed by inverse document
frequency, counted over all documents. The latent space are the leading right singular vectors of the
labelled sample. Every document meets every labelled vector in blocked products, exactly; its NEIGHBOURS
nearest ones vote with a power of their cosine, and each class's votes count for as many labelled
documents as its sample stands for.

The sample has at most about LABELLED documents of each label, drawn by a hash of the id, so what is
broadcast (their ids, vectors of DIMENSIONS and a projection of TERMS rows) has a fixed size. Labels,
language, source and id never enter a score.

Defined cases: a null or empty text scores 0; equal texts score alike; a labelled text that is scored
is its own neighbour only if it is in the sample; labels without document, null labels and labelled
null texts are not learnt from; both labels of one document are learnt from, repeated rows once (of
rows of one id the smallest text); without any label every score is 0; an empty table gives an empty result; other
columns, clashing names included, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm import quality, wordhash as W

#: Labelled documents of each label in the sample, about.
LABELLED = 2048
#: Hashed terms of trigrams and of text shapes, and dimensions of the latent space.
TRIGRAMS, SHAPES, DIMENSIONS = 4096, 64, 64
TERMS = TRIGRAMS + SHAPES
#: Neighbours that vote, and the power of the cosine that they vote with.
NEIGHBOURS, POWER = 15, 8
#: How much the terms of a text's shape weigh, each as a trigram that stands so often.
SHAPE_WEIGHT = 6.0
#: Texts that meet the labelled vectors at a time inside a task.
ROWS = 256
THRESHOLD = 0.7


def _shapes(texts: pa.Array) -> np.ndarray:
    """A row of SHAPES flags a text: for each measure the step of its range that the text is on."""
    counts = dict(zip(quality.COUNTS, quality.text_counts(texts), strict=True))
    n = np.maximum(1, counts["n_words"])
    cased = np.maximum(1, counts["n_upper"] + counts["n_lower"])
    measures = [
        counts["n_repeat_words"] / n, counts["n_dup_lines"] / np.maximum(1, counts["n_lines"]), counts["n_upper"] / cased, counts["n_symbol_words"] / n,
        counts["n_bare_words"] / n, counts["n_shout"] / n, counts["n_distinct"] / n, counts["n_ended"] / n,
    ]
    steps = SHAPES // len(measures)
    out = np.zeros((len(n), SHAPES), np.float32)
    for k, x in enumerate(measures):
        out[np.arange(len(n)), k * steps + np.minimum(steps - 1, np.sqrt(np.clip(x, 0, 1)) * steps).astype(np.int64)] = 1
    return out


def term_counts(texts: pa.Array) -> np.ndarray:
    """(text, term) -> count. Give it few texts at a time."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, data, text_at in W.slices(texts):
        n = len(text_at) - 1
        if len(data) < 3:
            continue
        doc = np.repeat(np.arange(n), np.diff(text_at))
        whole = doc[:-2] == doc[2:]
        b = data.astype(np.uint32)
        gram = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(20)
        out[row : row + n, :TRIGRAMS] = np.bincount(doc[:-2][whole] * TRIGRAMS + gram[whole], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    out[:, TRIGRAMS:] = _shapes(texts)
    return out


def _weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of damped and weighed counts."""
    x = np.log1p(counts) * idf
    x[:, TRIGRAMS:] = counts[:, TRIGRAMS:] * idf[TRIGRAMS:] * SHAPE_WEIGHT
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Documents that hold each term, over all documents, and their number as the last value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                counts = term_counts(batch.column(0).slice(at, ROWS))
                total[:TERMS] += (counts > 0).sum(0)
                total[TERMS] += len(counts)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["term", "n"])

    found = docs.select(text).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TERMS + 1, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


class Model:
    """Labelled vectors of a latent space, and how to get there."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, stands_for: dict[int, float], frequencies: np.ndarray):
        self.idf = np.log((1 + frequencies[TERMS]) / (1 + frequencies[:TERMS]) + 1).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.votes = np.array([stands_for[int(y)] for y in labels], np.float32)
        x = _weighed(counts, self.idf)
        self.projection = _leading(x, min(DIMENSIONS, *x.shape)).astype(np.float32) if len(x) else np.zeros((TERMS, 1), np.float32)
        self.vectors = _unit(x @ self.projection)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.vectors):
            return out
        for at in range(0, len(texts), ROWS):
            part = texts.slice(at, ROWS)
            vectors = _unit(_weighed(term_counts(part), self.idf) @ self.projection)
            cosines = np.maximum(0, vectors @ self.vectors.T)
            k = min(NEIGHBOURS, cosines.shape[1])
            near = np.argpartition(cosines, -k, axis=1)[:, -k:]
            votes = np.take_along_axis(cosines, near, axis=1).astype(np.float64) ** POWER * self.votes[near]
            out[at : at + ROWS] = np.divide((votes * self.labels[near]).sum(1), votes.sum(1), out=np.zeros(len(vectors)), where=votes.sum(1) > 0)
            out[at : at + ROWS][np.array([not t for t in part.to_pylist()], bool)] = 0
        return np.clip(out, 0, 1)


def _leading(x: np.ndarray, d: int, rounds: int = 3) -> np.ndarray:
    """The leading d right singular vectors of x, by randomised subspace iteration."""
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(x.shape[1], len(x), d + 16))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ np.linalg.qr(q)[0]))[0]
    return q @ np.linalg.svd(x @ q, full_matrices=False)[2][:d].T


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, terms, counts) of (text, label): what is sent of a text doesn't grow with it."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            counts = term_counts(part.column(0))
            held = [np.flatnonzero(x) for x in counts]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(held, pa.list_(pa.int32())), pa.array([x[h] for x, h in zip(counts, held, strict=True)], pa.list_(pa.float32()))], ["label", "terms", "counts"])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for tests: labels of others only are learnt."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model of a sample of the labelled documents that are not held out, with term frequencies of all documents."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).distinct()
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for y, count in n.items():
        share = F.when(F.col("label") == y, min(1 << 20, math.ceil((1 << 20) * LABELLED / count))).otherwise(share)
    # about LABELLED ids of each label, so they are sent to the texts; a repeated id is learnt once
    drawn = F.broadcast(known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").join(drawn, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    sample = rows.select("text", "label").mapInArrow(_sampled, "label int, terms array<int>, counts array<float>").toArrow()
    counts, drawn = np.zeros((len(sample), TERMS), np.float32), sample.column("label").to_numpy()
    for k, (terms, found) in enumerate(zip(sample.column("terms"), sample.column("counts"), strict=True)):
        counts[k, terms.values.to_numpy()] = found.values.to_numpy()
    order = np.lexsort((counts.sum(1), drawn))  # whatever order the rows came in
    stands_for = {y: n[y] / max(1, int((drawn == y).sum())) for y in n}
    return Model(counts[order], drawn[order], stands_for, document_frequencies(docs, text))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text))

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.score(texts))

    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), scored(text).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
