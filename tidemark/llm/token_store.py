"""Token ids in patched frame-of-reference blocks.

A store is a Parquet table whose rows are segments: whole documents in ascending doc_id order, their
ids as one byte string in this layout (little-endian):

    4 bytes magic, u32 ids, u32 blocks, u32 exceptions
    u32[blocks]  where each block's packed words start (the block index)
    u32[blocks]  minimum, subtracted from all ids of the block
    u8[blocks]   width in bits, u8[blocks] number of exceptions
    u64[...]     packed words: BLOCK values of ``width`` bits each, lowest bits first
    u8[exceptions] place in the block, u32[exceptions] value less the minimum

The width of a block is what its PERCENTILE-th value needs; larger ones are exceptions. The last block
is filled up with its last id. Segments of one part follow each other by ``start_in_part``, parts by
number, so the position of every document in the whole corpus follows from the files alone.

Documents are dealt out by doc_id ranges and sorted inside a part; ids never leave the tasks but as
segments. A lost executor means that its parts are written again, under the committer's rename.

Defined cases: a null text has only the end id; null doc_ids come first; repeated doc_ids are ordered
by their text's hash (equal rows are interchangeable); an empty table gives an empty store. A
document is never split over segments, so a segment is as large as its largest document at least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm import tokens, wordhash as W
from tidemark.llm.storage import table_path

MAGIC, BLOCK, PERCENTILE, SEGMENT_IDS = b"PFR1", 128, 90, 1 << 20
SEGMENT = "part int, seq int, start_in_part long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
_SEGMENT_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 needs none."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _lanes(width: int) -> Iterator[tuple[int, int, int, bool]]:
    """(value, word, shift, goes on in the next word) of the values of a block."""
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        yield i, word, shift, shift + width > 64


def pack(ids: np.ndarray) -> bytes:
    """The layout above for a run of ids."""
    n = len(ids)
    if n % BLOCK:
        ids = np.concatenate([ids, np.full(BLOCK - n % BLOCK, ids[-1], ids.dtype)])
    blocks = ids.astype(np.uint32).reshape(-1, BLOCK)
    least = blocks.min(1) if n else np.zeros(0, np.uint32)
    rel = blocks - least[:, None]
    rank = BLOCK * PERCENTILE // 100
    width = _bits(np.partition(rel, rank, axis=1)[:, rank]) if n else np.zeros(0, np.uint8)
    over = rel >> width[:, None].astype(np.uint32) != 0
    row, place = np.nonzero(over)
    low = (rel & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]).T.astype(np.uint64, order="C")
    size = 2 * width.astype(np.int64)
    start = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        chosen = np.flatnonzero(width == w)
        values, out = low[:, chosen], np.zeros((2 * w, len(chosen)), np.uint64)
        for i, word, shift, more in _lanes(w):
            out[word] |= values[i] << np.uint64(shift)
            if more:
                out[word + 1] |= values[i] >> np.uint64(64 - shift)
        words[start[chosen][:, None] + np.arange(2 * w)] = out.T
    head = MAGIC + np.array([n, len(blocks), len(row)], "<u4").tobytes()
    return head + b"".join(x.tobytes() for x in (start.astype("<u4"), least.astype("<u4"), width, over.sum(1).astype(np.uint8), words.astype("<u8"), place.astype(np.uint8), rel[row, place].astype("<u4")))


def unpack(data: bytes) -> np.ndarray:
    """The ids of a packed run."""
    if data[:4] != MAGIC:
        raise ValueError("not a run of packed ids")
    n, n_blocks, n_over = np.frombuffer(data, "<u4", 3, 4).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    start, least, width, exceptions = take("<u4", n_blocks), take("<u4", n_blocks), take("u1", n_blocks), take("u1", n_blocks)
    words = take("<u8", int(2 * width.astype(np.int64).sum()))
    place, value = take("u1", n_over), take("<u4", n_over)
    rel = np.zeros((BLOCK, n_blocks), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        chosen = np.flatnonzero(width == w)
        packed = words[start[chosen].astype(np.int64)[:, None] + np.arange(2 * w)].T.copy()
        mask, values = np.uint64((1 << w) - 1), np.empty((BLOCK, len(chosen)), np.uint64)
        for i, word, shift, more in _lanes(w):
            x = packed[word] >> np.uint64(shift)
            if more:
                x |= packed[word + 1] << np.uint64(64 - shift)
            values[i] = x & mask
        rel[:, chosen] = values
    out = rel.T.astype(np.uint32)
    out[np.repeat(np.arange(n_blocks), exceptions), place] = value
    return (out + least[:, None]).reshape(-1)[:n]


def _segments(rows: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    own = tokens.encoder(path)
    part = TaskContext.get().partitionId()
    seq = start = held = 0
    keys: list[pa.Array] = []
    runs: list[np.ndarray] = []
    lengths: list[np.ndarray] = []

    def segment() -> pa.RecordBatch:
        ids = np.concatenate(runs)
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        row = [pa.array([v], t) for v, t in zip((part, seq, start, len(ids)), _SEGMENT_ARROW.types[:4], strict=True)]
        return pa.RecordBatch.from_arrays([*row, listed(pa.concat_arrays(keys)), listed(pa.array(np.concatenate(lengths))), pa.array([pack(ids)], pa.binary())], schema=_SEGMENT_ARROW)

    for batch in rows:
        doc_ids = batch.column("doc_id")
        for row, data, text_at in W.slices(batch.column("text"), tokens.BATCH_BYTES):
            ids, n = own.encode(data, text_at)
            ids = np.insert(ids, np.cumsum(n), end_id)
            ends = np.cumsum(n + 1)
            at = 0  # documents of this run that are in a segment
            while at < len(n):
                before = ends[at - 1] if at else 0
                to = min(len(n), int(np.searchsorted(ends, before + SEGMENT_IDS - held)) + 1)
                keys.append(doc_ids.slice(row + at, to - at))
                runs.append(ids[before : ends[to - 1]])
                lengths.append(n[at:to] + 1)
                held, at = held + len(runs[-1]), to
                if held >= SEGMENT_IDS:
                    yield segment()
                    seq, start, held = seq + 1, start + held, 0
                    keys, runs, lengths = [], [], []
    if runs:
        yield segment()


def write_store(docs: DataFrame, to: str, path: str | None = None, end_id: int = 0) -> None:
    """Encode all texts and write them to ``to`` as segments."""
    path = path or tokens.path_of()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows.select("doc_id", "text").mapInArrow(lambda batches: _segments(batches, path, end_id), SEGMENT).write.option("compression", "none").parquet(to)


def _documents(segments: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in segments:
        for part, start, doc_ids, lengths, payload in zip(*(batch.column(c) for c in ("part", "start_in_part", "doc_ids", "lengths", "payload")), strict=True):
            ids = memoryview(unpack(payload.as_buffer()).astype("<u4").tobytes())
            counts = np.array(lengths.as_py(), np.int64)
            first = np.cumsum(counts) - counts
            sums = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids.as_py(), pa.int64()), pa.array(np.full(len(counts), part.as_py(), np.int32)), pa.array(first + start.as_py()), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold for each document: doc_id, start among all ids, n_tokens, ids_crc32."""
    segments = spark.read.parquet(path)
    found = segments.select("part", "start_in_part", "doc_ids", "lengths", "payload").mapInArrow(_documents, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    # one row for each part, so as many as the write had tasks
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return found.join(F.broadcast(parts.select("part", "before")), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the store to the shared folder and read it back."""
    write_store(docs, to := table_path(docs.sparkSession, "token-store"), path)
    return read_documents(docs.sparkSession, to)
