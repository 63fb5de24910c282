"""Token counts and token ids of whole texts, as the ``tokenizers`` library gives them.

A byte-level pre-tokeniser always starts a new piece at a single space or line break between two
non-space characters, and merges never cross pieces. A batch of texts is therefore cut there, over its
bytes; Arrow finds the distinct pieces, and each of them goes through the library once a worker:
pieces that a worker has not met are encoded together, the rest comes from a table of bounded size.
Where white space is not single, the text stays whole around it. Special tokens in a text are the
library's business: they hold no white space.

Defined cases: a null text counts as empty and has no tokens; repeated rows and ties are counted like
any other row; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from tidemark.llm import wordhash as W

DEFAULT_FILE = "byte_bpe_50k.json"
#: Most pieces kept in a worker's table, bytes of the longest kept, the new pieces in one call, and the bytes of text in a batch.
TABLE_PIECES, PIECE_BYTES, LINES, BATCH_BYTES = 1_000_000, 48, 4096, 4 << 20

#: ASCII characters next to which no text is cut. Other white space is found by its bytes.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes of white space beyond ASCII, and what follows them.
_WIDE = {0xC2: ((0x85,), (0xA0,)), 0xE1: ((0x9A, 0x80),), 0xE2: (*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F)), 0xE3: ((0x80, 0x80),)}


def piece_starts(data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Byte positions at which a piece begins: the starts of the texts, and their safe boundaries."""
    blank = _BLANK[data]
    space = np.flatnonzero((data == 0x20) | (data == 0x0A))
    for first, rests in _WIDE.items():
        lead = np.flatnonzero(data == first)
        for rest in rests:
            at = lead[lead + len(rest) < len(data)]
            for k, byte in enumerate(rest, 1):
                at = at[data[at + k] == byte]
            for k in range(len(rest) + 1):
                blank[at + k] = True
    space = space[(space > 0) & (space < len(data) - 1)]
    starts = np.zeros(len(data) + 1, bool)
    starts[text_at] = True
    safe = space[~blank[space - 1] & ~blank[space + 1] & ~starts[space] & ~starts[space + 1]]
    starts[safe] = True
    return np.flatnonzero(starts[: len(data)])

#: A word of letters that no Unicode version doubts, and punctuation after it: one pre-token each, so the library's model encodes them alone.
_WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write each byte: visible characters stand for themselves, the others for those from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 0x100 + k for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class PieceEncoder:
    """Encodes texts piece by piece; a table maps the bytes of a piece to its place among the ids of all known pieces."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._forget()
        made = json.loads(self.tokenizer.to_str())
        splits = made["pre_tokenizer"] or {}
        #: The safe boundaries hold for byte-level splitting of the text as it is; else texts stay whole.
        self.cuts = made["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
        #: Whether the model may be asked without what stands before it: no added token can stand in a word.
        self.direct = self.cuts and made["model"]["type"] == "BPE" and not made["model"].get("dropout") and not any(_WORD.search(t["content"]) and not re.search(r"[^\w .,;:!?]", t["content"]) for t in made["added_tokens"])
        self.line_break = self._ids(["\n"])[0]

    def _forget(self) -> None:
        self.table: dict[bytes, int] = {}
        self.ids, self.at, self.kept = np.zeros(0, self.kind), np.zeros(1, np.int64), 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all lines, number of each line's), read from one text: a line break between pieces without white space inside is a token of its own."""
        ids = self._ids(["\n".join(lines)])[0]
        cut = np.flatnonzero(ids == self.line_break[0])
        if len(self.line_break) == 1 and len(cut) == len(lines) - 1:
            return np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
        return self._each(lines)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._ids(texts)
        return np.concatenate([np.zeros(0, self.kind), *found]), np.array([len(x) for x in found], np.int64)

    def _model(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(_LETTERS))]

    def _words(self, words: list[re.Match]) -> tuple[np.ndarray, np.ndarray]:
        tails = {tail: self._model(tail) for tail in {m[2] for m in words} if tail}
        ids: list[int] = []
        ends = []
        for m in words:
            ids += self._model(m[1])
            if m[2]:
                ids += tails[m[2]]
            ends.append(len(ids))
        return np.array(ids, self.kind), np.diff(np.array([0, *ends], np.int64))

    def _learn(self, new: list[bytes]) -> None:
        """Puts pieces into the table, long ones last."""
        words, plain, starts, rest, long = [], [], [], [], []
        for p in new:
            text = p.decode()
            word = text[1:] if text[0] in " \n" else text
            if len(p) > PIECE_BYTES:
                long.append(text)
            elif self.direct and (found := _WORD.fullmatch(text)):
                words.append(found)
            # of all white space only " " is printable
            elif not word or " " in word or not word.isprintable():
                rest.append(text)
            else:
                (starts if text[0] == "\n" else plain).append(text)
        found = [self._words(words), *(self._lines(plain[k : k + LINES]) for k in range(0, len(plain), LINES))]
        for k in range(0, len(starts), LINES):
            ids, n = self._lines([p[1:] for p in starts[k : k + LINES]])
            found.append((np.insert(ids, np.repeat(np.cumsum(n) - n, len(self.line_break)), np.tile(self.line_break, len(n))), n + len(self.line_break)))
        found += [self._each(rest), self._each(long)]
        order = [*(m[0] for m in words), *plain, *starts, *rest, *long]
        self.kept = len(self.table) + len(order) - len(long)
        self.table.update(zip((p.encode() for p in order), range(len(self.table), len(self.table) + len(order)), strict=True))
        self.ids = np.concatenate([self.ids, *(x for x, _ in found)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate([n for _, n in found]))])

    def _pieces(self, data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table of each piece, first piece of each text and their number)."""
        starts = piece_starts(data, text_at)
        offsets = np.append(starts, len(data)).astype(np.int64)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = cut.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.table]
        if len(self.table) + len(new) > TABLE_PIECES and self.table:
            self._forget()
            new = distinct
        if new:
            self._learn(new)
        place = np.fromiter(map(self.table.__getitem__, distinct), np.int64, len(distinct))
        return place[cut.indices.to_numpy()], np.searchsorted(starts, text_at)

    def _drop_long(self) -> None:
        """Long pieces, which were learned last, leave the table after their batch."""
        if len(self.table) > self.kept:
            while len(self.table) > self.kept:
                self.table.popitem()
            self.ids, self.at = self.ids[: self.at[self.kept]], self.at[: self.kept + 1]

    def counts(self, data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
        """The number of ids of each text of a run of texts."""
        return self.encode(data, text_at, ids=False)[1]

    def encode(self, data: np.ndarray, text_at: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a run of texts, number of each text's)."""
        if not self.cuts:
            raw = data.tobytes()
            return self._each([raw[a:b].decode() for a, b in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)])
        place, first = self._pieces(data, text_at)
        lengths = self.at[place + 1] - self.at[place]
        ends = np.append(0, np.cumsum(lengths))
        found = self.ids[np.repeat(self.at[place] - ends[:-1], lengths) + np.arange(ends[-1])] if ids else self.ids[:0]
        self._drop_long()
        return found, ends[first[1:]] - ends[first[:-1]]


@lru_cache(1)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    return PieceEncoder(path)


def path_of(name: str = DEFAULT_FILE) -> str:
    return str(public_tokenizers.path(name))


def token_count(text: str | F.Column, path: str) -> F.Column:
    """The number of tokens of a text column; only these numbers leave the Python workers."""

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(own.counts(data, at) for _, data, at in W.slices(texts, BATCH_BYTES))]))

    return count(text)


def count_tokens(docs: DataFrame, keep: list[str], path: str | None = None, limit: int = 512) -> DataFrame:
    """``keep`` with n_bytes, n_tokens and over_limit of each row."""
    rows = docs.select(*keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count("text", path or path_of()).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
