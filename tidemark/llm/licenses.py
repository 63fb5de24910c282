"""License scans by template-markup matching.

Templates (``license_templates``) mark optional and replaceable regions. Each is compiled into an
automaton over words; a text is accepted at a place where all mandatory wording stands exactly, with
optional regions left out or whole and replaceable regions of any words up to their length. All
automata run together: active states move on each word, new runs start at words that can begin a
template. Words that no template holds end every run that is not in a replaceable region, so the
scan visits only places where a first word occurs.

Three base phrases are counted besides. Defined cases: a null text counts as empty and has no words;
repeated rows and ties are scanned each; an empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.license_templates import TEMPLATES

BASE = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MARK = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+")
SCAN = T.StructType(
    [T.StructField("n_words", T.LongType(), False), T.StructField("n_base", T.LongType(), False), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType(), False), T.StructField("labels", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
)


def lowered(text: str) -> str:
    """The text with A-Z in lower case and nothing else changed."""
    return text.encode().translate(_LOWER).decode()


class Automata:
    """All templates as one nondeterministic automaton without empty moves.

    States are numbered; ``step[state]`` maps a word to the states it leads to, ``other[state]`` lists
    the states that any word leads to, ``accept[state]`` is the label that is recognised there.
    """

    def __init__(self, templates: dict[str, list[str]]):
        self.step: list[dict[str, list[int]]] = []
        self.other: list[list[int]] = []
        self.accept: dict[int, str] = {}
        self.start: dict[str, list[int]] = defaultdict(list)
        for label, texts in sorted(templates.items()):
            for text in texts:
                self._add(label, _MARK.findall(text))

    def _state(self) -> int:
        self.step.append(defaultdict(list))
        self.other.append([])
        return len(self.step) - 1

    def _add(self, label: str, marks: list[str]) -> None:
        # positions 0..n between units; empty[i]: positions reached from i without a word
        units: list[str | None] = []  # a word, or None for any word
        empty: dict[int, set[int]] = defaultdict(set)
        opened: list[int] = []
        for m in marks:
            if m == "[[":
                opened.append(len(units))
            elif m == "]]":
                empty[opened.pop()].add(len(units))
            elif m.startswith("{{"):
                for _ in range(int(m[2:-2])):
                    empty[len(units)].add(len(units) + 1)
                    units.append(None)
            else:
                units.append(m)
        if opened:
            raise ValueError(f"template of {label}: an optional region isn't closed")
        states = [self._state() for _ in range(len(units) + 1)]

        def closure(i: int) -> set[int]:
            seen, todo = {i}, [i]
            while todo:
                for j in empty[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            return seen

        reach = [closure(i) for i in range(len(units) + 1)]
        for i in range(len(units) + 1):
            for j in reach[i]:
                if j == len(units):
                    self.accept[states[i]] = label
                elif units[j] is None:
                    self.other[states[i]].append(states[j + 1])
                else:
                    self.step[states[i]][units[j]].append(states[j + 1])
        if len(units) in reach[0] or self.other[states[0]]:
            raise ValueError(f"template of {label}: it needs a mandatory word before any replaceable region")
        for word, to in self.step[states[0]].items():
            self.start[word] += to

    def scan(self, words: list[str]) -> set[str]:
        """Labels of the templates that are accepted somewhere."""
        found: set[str] = set()
        places = [i for i, w in enumerate(words) if w in self.start]
        active: set[int] = set()
        at, k = 0, 0
        while k < len(places) or active:
            if not active:
                at = places[k]
            word = words[at] if at < len(words) else None
            if word is None:
                break
            now = {t for s in active for t in (*self.step[s].get(word, ()), *self.other[s])}
            if k < len(places) and places[k] == at:
                now.update(self.start[word])
                k += 1
            found.update(self.accept[s] for s in now if s in self.accept)
            active, at = now, at + 1
        return found


@lru_cache(1)
def _automata() -> Automata:
    return Automata(TEMPLATES)


def scan(text: str) -> tuple:
    """The SCAN fields of a text. score: 1 with a template, 0.5 with base phrases only, else 0."""
    text = lowered(text)
    words = _WORD.findall(text)
    places: list[int] = []
    base = []
    for label, phrase in sorted(BASE.items()):
        if all(p in text for p in phrase):
            n = len(phrase)
            hits = [i for i in range(len(words) - n + 1) if words[i] == phrase[0] and tuple(words[i : i + n]) == phrase]
            if hits:
                base.append(label)
                places += hits
    own = _automata().scan(words)
    labels = ",".join(sorted({*own, *base}))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), labels, 1.0 if own else 0.5 if base else 0.0


@F.arrow_udf(SCAN)
def _scan(texts: pa.Array) -> pa.Array:
    columns = list(zip(*(scan(x.as_py() or "") for x in texts), strict=True)) or [[] for _ in SCAN.fields]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], SCAN.names)


def scan_licenses(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the SCAN fields of each row."""
    return docs.select(*keep, _scan("text").alias("s")).select(*keep, "s.*")
