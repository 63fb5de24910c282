"""Main text of web pages as the maximum-scoring run of tokens.

A page is a sequence of tags and words. Words score positive, unless an element around them is
typical of what surrounds main text; tags score negative. One linear scan finds the contiguous region
with the greatest sum. The region tells which container holds the main text: the least ``div``,
``section``, ``td`` or the like with nearly all of its words, or the ``article`` (else ``main``) around
that. All text of the container is main text but for words in boilerplate elements, so a share bar
below a heading or an advert before the last paragraph costs nothing of the article. Where only the
page itself holds the region, text of the page outside the region counts too unless elements around it
speak against it.

The weights come from labelled pages: pages whose author marks the main text with an ``article`` or
``main`` element. For each tag name and each class, id or role name, Spark counts words inside and
outside that element over a sample of at most about LABELLED such pages, drawn by a hash; PRIOR gives
names that are boilerplate by their meaning a start, so that rare ones are known too. Names count
whole: ``share-price`` is not ``share``.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by a line break; empty blocks vanish. Defined cases: null html counts as empty, an
empty page gives an empty text, repeated pages are extracted each, an empty table gives an empty
result; very long pages, deep nesting, attribute values of any length and broken tags included, are
scanned whole in linear time; a tag that is cut off by another one ends there. Other columns, clashing names
included, are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

LABELLED = 2000
#: Words that a prior counts as seen outside main text; the weight from which an element is boilerplate.
PRIOR_WORDS, LIMIT = 400.0, -1.0
#: Element names and attribute words that never hold main text by their meaning.
PRIOR_TAGS = {"head", "title", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "input", "label", "script", "style", "noscript", "template", "iframe", "svg", "dialog", "menu"}
PRIOR_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "disclaimer", "disqus", "footer", "gdpr", "header",
    "login", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
MAIN = {"article", "main"}
#: Elements that can be the container of main text, and the share of the region's words that it must hold.
_BOXES, BOX_SHARE = {"div", "section", "article", "main", "td", "center", "body"}, 0.9
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label",
}
#: Elements that are common around main text, but found inside it too.
_SOFT = {f"<{t}>" for t in (*_INLINE, "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tr", "td", "th", "figure", "figcaption", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6") if t != "label"}
#: An open element of the same name is closed by the next one.
_SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "iframe", "textarea", "svg")}
_BEGIN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-z][^\s/<>]*+))", re.I)
#: The rest of a tag whose quoted values hold no angle brackets, and of a tag that is cut off.
_PLAIN, _CUT = re.compile(r"""((?:[^<>"']|"[^"<>]*+"|'[^'<>]*+')*+)>"""), re.compile(r"([^<>]*+)>?")
_STOP = re.compile(r"""["'<>]""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
#: Words of layout, which say nothing about what an element holds.
LAYOUT = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "desktop", "global", "inner", "item", "items", "left", "link", "links", "list", "main", "mobile", "outer", "page", "primary", "right", "row", "secondary", "section", "site", "slot", "top", "unit", "wrap", "wrapper"}


@lru_cache(1 << 16)
def _name_features(name: str) -> tuple[str, ...]:
    """The name, whole, and the boilerplate word in it if all its other parts are boilerplate or layout: ``site-footer`` is a footer, ``share-price`` is not a share button."""
    parts = _PART.findall(name)
    own = [p for p in parts if p in PRIOR_NAMES]
    return (name, *own[:1]) if own and name not in PRIOR_NAMES and all(p in PRIOR_NAMES or p in LAYOUT for p in parts) else (name,)


def features(tag: str, attributes: str) -> tuple[str, ...]:
    """Names that describe an element: its tag, and those of its class, id and role."""
    found = [f"<{tag}>"]
    if "=" in attributes:
        found += (f for m in _NAMES.findall(attributes) for name in "".join(m).lower().split() for f in _name_features(name))
    return tuple(found)


def tokens(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """(kind, value, features): "text" with the raw text, "open" and "close" with the tag name. Comments and raw elements vanish."""
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    dead: set[int] = set()
    while m := _BEGIN.search(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()], ()
        if m[3] is None:
            end = page.find("-->" if m[1] else ">", m.end())
            at = n if end < 0 else end + (3 if m[1] else 1)
            continue
        tag, begin = m[3].lower(), m.end()
        plain = _PLAIN.match(page, begin)
        stop = plain.end(1) if plain else _tag_stop(page, begin, last, dead)
        if stop >= 0 and not m[2] and tag in _RAW:
            end = _RAW[tag].search(page, stop + 1)
            at = end.end() if end else n
            continue
        cut = None if stop >= 0 else _CUT.match(page, begin)
        at = cut.end() if cut else stop + 1
        yield ("close", tag, ()) if m[2] else ("open", tag, features(tag, page[begin : cut.end(1) if cut else stop]))
    if at < n:
        yield "text", page[at:], ()


def _tag_stop(page: str, at: int, last: dict[str, int], dead: set[int]) -> int:
    """Where the ">" of a tag stands whose attributes begin at a place; -1 if an unquoted "<" or the end comes first.

    ``last`` has the last place of each quote. What follows the end of a quoted value is the same for every
    tag that gets there, so ``dead`` keeps the ends from which no ">" is reached, and a page takes linear time.
    """
    passed = []
    while (m := _STOP.search(page, at)) and m[0] != "<":
        if m[0] == ">":
            return m.start()
        if m.start() == last[m[0]]:
            break
        at = page.index(m[0], m.end()) + 1
        if at in dead:
            break
        passed.append(at)
    dead.update(passed)
    return -1


class Element(NamedTuple):
    tag: str
    names: tuple[str, ...]
    in_main: bool
    #: The place of the innermost element that is not inline, this one included.
    solid: int
    #: The least weight of this element and those around it, and whether one of them makes boilerplate.
    least: float
    hard: bool
    #: The innermost container, by its number.
    box: int


class Path:
    """The open elements around a token. Each knows what holds for all around it, so a step takes no longer on a deep path."""

    def __init__(self, weights: Weights | None = None) -> None:
        self.weights, self.open, self.count = weights, [], Counter()
        #: (tag, number of the container around it) of each container; the first is the page itself.
        self.boxes: list[tuple[str, int]] = [("", 0)]

    @property
    def top(self) -> Element:
        return self.open[-1] if self.open else _NOTHING

    def _cut(self, k: int) -> list[Element]:
        gone = self.open[k:]
        del self.open[k:]
        self.count.subtract(e.tag for e in gone)
        return gone

    def step(self, kind: str, tag: str, names: tuple[str, ...]) -> list[Element]:
        """Opens or closes an element; returns those that are closed by it."""
        if kind == "close":
            k = len(self.open)
            if not self.count[tag]:
                return []
            while self.open[k - 1].tag != tag:
                k -= 1
            return self._cut(k - 1)
        gone = []
        if tag in _SELF_CLOSING and self.open and (k := self.top.solid) >= 0 and self.open[k].tag == tag:
            gone = self._cut(k)
        if tag not in _VOID:
            up = self.top
            in_main = up.in_main or tag in MAIN
            least, hard = self.weights.element_score(names, in_main) if self.weights else (0.0, False)
            box = up.box
            if tag in _BOXES:
                box = len(self.boxes)
                self.boxes.append((tag, up.box))
            self.open.append(Element(tag, names, in_main, up.solid if tag in _INLINE else len(self.open), min(up.least, least), up.hard or hard, box))
            self.count[tag] += 1
        return gone


_NOTHING = Element("", (), False, -1, 0.0, False, 0)


def label_counts(page: str) -> Counter:
    """(feature, inside main text) -> words; ("#tag", inside) -> occurrences of the tag."""
    path, found = Path(), Counter()
    words = [0, 0]  # outside and inside main text, so far
    begun: dict[str, tuple[int, int]] = {}
    depth: Counter = Counter()

    def ended(elements: list[Element]) -> None:
        for e in elements:
            for f in e.names if e.tag not in MAIN else ():
                depth[f] -= 1
                if not depth[f]:
                    for inside in (0, 1):
                        if n := words[inside] - begun[f][inside]:
                            found[f, bool(inside)] += n

    for kind, value, names in tokens(page):
        if kind == "text":
            words[path.top.in_main] += len(value.split())
        else:
            found[f"#{value}", path.top.in_main] += 1
            n = len(path.open)
            gone = path.step(kind, value, names)
            ended(gone)
            if kind == "open" and len(path.open) > n - len(gone) and value not in MAIN:
                for f in names:
                    if not depth[f]:
                        begun[f] = (words[0], words[1])
                    depth[f] += 1
    ended(path.open)
    return found


_COUNTS = "feature string, inside boolean, n long"


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            total.update(label_counts(page or ""))
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["feature", "inside", "n"])


class Weights:
    """Scores of words by the elements around them, and of tags."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        self.element: dict[str, float] = {}
        self.tag: dict[str, float] = {}
        names = {f for f, _ in counts}
        for f in names | PRIOR_NAMES | {f"<{t}>" for t in PRIOR_TAGS}:
            inside, outside = counts.get((f, True), 0), counts.get((f, False), 0)
            if f.startswith("#"):
                self.tag[f[1:]] = -min(0.3, max(0.02, 0.3 * (outside + 1) / (inside + outside + 2)))
            else:
                prior = PRIOR_WORDS if f in PRIOR_NAMES or f.strip("<>") in PRIOR_TAGS and f[0] == "<" else 0.0
                self.element[f] = math.log((inside + 20.0) / (outside + prior + 20.0))
        # elements that hold all of a page say nothing
        for f in ("<html>", "<body>", "<div>", "<section>", "<span>", "<p>", *(f"<{t}>" for t in MAIN)):
            self.element[f] = 0.0

    def element_score(self, names: tuple[str, ...], in_main: bool) -> tuple[float, bool]:
        """(least weight of an element's names, whether it is boilerplate). A header inside main text is part of it.

        Elements of lists, tables and links lower the score, but don't make boilerplate by themselves.
        """
        least, hard = 0.0, False
        for f in names:
            if in_main and f in ("<header>", "header"):
                continue
            w = self.element.get(f, 0.0)
            least = min(least, w)
            hard |= w <= LIMIT and f not in _SOFT
        return least, hard


def word_score(e: Element) -> float:
    """The score of a word in an element."""
    if e.least > LIMIT:
        return 1.0
    return -0.1 if e.hard else max(-1.0, e.least)


def extract(page: str, weights: Weights) -> str:
    """The main text of a page."""
    path, blocks = Path(weights), 0
    parts: list[tuple[int, int, str, Element, int]] = []  # (token, block, text, element, words) outside boilerplate
    best, best_from, best_to = 0.0, 0, -1
    total, begin = 0.0, 0
    for i, (kind, value, names) in enumerate(tokens(page)):
        if kind == "text":
            n = len(value.split())
            score = 0.0
            if n:
                each = word_score(path.top)
                score = max(-3.0, n * each) if path.top.hard else n * each
                if not path.top.hard:
                    parts.append((i, blocks, value, path.top, n))
            elif value:
                parts.append((i, blocks, value, path.top, 0))
        else:
            score = weights.tag.get(value, -0.1)
            path.step(kind, value, names)
            if value not in _INLINE:
                blocks += 1
            elif value == "br":
                parts.append((i, blocks, " ", path.top, 0))
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, best_from, best_to = total, begin, i
    if best_to < 0:
        return ""
    held, marked, whole_page = _container(path.boxes, [(e.box, n) for i, _, _, e, n in parts if best_from <= i <= best_to])
    lines: dict[int, list[str]] = {}
    for i, block, text, e, _ in parts:
        if (held[e.box] and (not whole_page or e.least > LIMIT)) or (not marked and best_from <= i <= best_to):
            lines.setdefault(block, []).append(text)
    done = (" ".join(html.unescape("".join(x)).split()) for x in lines.values())
    return "\n".join(x for x in done if x)


def _container(boxes: list[tuple[str, int]], words: list[tuple[int, int]]) -> tuple[list[bool], bool, bool]:
    """For each container whether it lies in that of the main text; whether the author marked that; whether it is the whole page."""
    counts = [0] * len(boxes)
    for box, n in words:
        counts[box] += n
    for k in range(len(boxes) - 1, 0, -1):  # a container comes after the one around it
        counts[boxes[k][1]] += counts[k]
    chosen = max(k for k, n in enumerate(counts) if n >= BOX_SHARE * counts[0])
    around = [chosen]
    while around[-1]:
        around.append(boxes[around[-1]][1])
    marks = [next((k for k in around if boxes[k][0] == tag), None) for tag in ("article", "main")]
    marked = next((k for k in marks if k is not None), None)
    chosen = chosen if marked is None else marked
    held = [k == chosen for k in range(len(boxes))]
    for k in range(1, len(boxes)):
        held[k] = held[k] or held[boxes[k][1]]
    return held, marked is not None, boxes[chosen][0] in ("", "body")


def fit(pages: DataFrame) -> Weights:
    """Weights from a sample of the pages that mark their main text. The driver sees a row for each name in the sample."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    n = marked.count()
    share = min(1 << 20, math.ceil((1 << 20) * LABELLED / max(1, n)))
    sample = marked.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < share).select("html")
    counted = sample.mapInArrow(_count_batches, _COUNTS).groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    return Weights({(r["feature"], r["inside"]): r["n"] for r in counted.collect()})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    weights = fit(pages)

    @F.arrow_udf(T.StringType())
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py() or "", weights) for x in column], pa.string())

    return pages.select("page_id", "url", text_of("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
