"""Word and n-gram hashes of whole Arrow batches, without a Python step per word.

A batch of texts is one byte buffer. Words are maximal runs of bytes of a given class; a word's hash
is a polynomial over its bytes modulo 2^64, read from one running sum, then mixed. UTF-8 keeps
ASCII bytes out of longer characters, so classes made of ASCII bytes and "all above 0x7F" are exact.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes of text that are handled at a time; a longer text is handled alone.
SLICE_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_WHITE = ~WHITE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0 to n-1 of the base ("up") or of its inverse ("down")."""
    have = _powers[kind]
    if len(have) < n:
        row = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        row[0] = 1
        made = np.multiply.accumulate(row)
        if n > SLICE_BYTES + 1:  # do not keep what a single very long text needed
            return made
        have = _powers[kind] = made
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64 bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of consecutive texts: ``first`` to ``end`` are byte positions in ``data``."""

    data: np.ndarray  # bytes of all texts
    text_at: np.ndarray  # byte position of each text, and the end
    doc: np.ndarray  # text of each word
    first: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    word_at: np.ndarray  # first word of each text, and the count


def give_back() -> None:
    """Returns freed memory of this process to the system: a worker that waits for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` bytes: (row of the first, bytes, offsets). A null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, raw[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


def runs(inside: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True that stays in one text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[0] = edge[n] = True
    edge[text_at] = True
    cut = np.flatnonzero(edge)
    first, end = cut[:-1], cut[1:]
    keep = inside[first]
    return first[keep], end[keep]


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power("up", len(data)), out=total[1:])
    down = _power("down", len(data) + 1)
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def words(data: np.ndarray, text_at: np.ndarray, inside: np.ndarray) -> Words:
    """All words, given the 256 flags of the bytes that words are made of."""
    first, end = runs(inside[data], text_at)
    hashes = span_hashes(data, first, end) if len(first) else np.zeros(0, np.uint64)
    word_at = np.searchsorted(first, text_at)
    doc = np.repeat(np.arange(len(text_at) - 1), np.diff(word_at))
    return Words(data, text_at, doc, first, end, hashes, word_at)


def grams(w: Words, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of each k-word window. short: a text with fewer words, but one at least, has one window of what it has."""
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = w.word_at[1:][w.doc]
    at = np.arange(n)
    whole = at + k <= end
    if short:
        start = w.word_at[:-1][w.doc]
        whole |= (at == start) & (end - start < k)
    at = at[whole]
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        step = U64((0xD6E8FEB86659FD93 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF)
        take = np.minimum(at + j, n - 1)
        part = mix(w.hashes[take] + step)
        if short:
            part = np.where(at + j < end[at], part, U64(0))
        out = out * U64(0xC2B2AE3D27D4EB4F) + part
    return at, mix(out)


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive positions."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
