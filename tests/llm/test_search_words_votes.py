"""Operators 11 to 13 against brute force and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import SHAPE, prose, rows
from tidemark.llm import quality_knn, ranked_search, spelling
from tidemark.operators import topk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


# 11 ranked lexical search


def brute_search(table, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counted = [(d, Counter(split(t))) for d, t in table]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


ITEMS = [
    (1, prose(5, 40)), (2, "W1 w2 W1-w3!"), (3, "w7"), (4, None), (5, ""), (6, "nowhere at all"), (7, prose(1000, 300)), (8, "w1"), (8, "w2 w3"), (None, "w9 changed"), (9, "Ärger öl w5"), (9, "Ärger öl w5"),
]


def test_search_matches_brute_force(spark, docs, none):
    more = [(400 + i, "w1 w2 " * (i + 1) + "Ärger" * (i % 2)) for i in range(40)]
    table = [(r[0], r[1]) for r in rows()] + more + more[:3]
    corpus = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, doc_id int")
    want = brute_search(table, ITEMS)
    index = ranked_search.build(corpus).cache()
    assert sorted((tuple(r) for r in ranked_search.search(index, items).collect()), key=str) == want
    assert index.selectExpr("sum(size(sizes))").first()[0] == len(table) and index.where("text IS NOT NULL").count() == sum(bool(re.search(r"\w", t or "")) for _, t in table)
    empty = ranked_search.build(none)
    assert ranked_search.search(empty, items).collect() == [] and ranked_search.search(index, items.limit(0)).collect() == []
    assert ranked_search.search(empty, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_in_batches_is_the_same(spark, docs, monkeypatch):
    index = ranked_search.build(docs).cache()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted((tuple(r) for r in ranked_search.search(index, items).collect()), key=str)
    monkeypatch.setattr(topk, "SENT_ROWS", 2)
    assert sorted((tuple(r) for r in ranked_search.search(index, items).collect()), key=str) == whole == brute_search([(r[0], r[1]) for r in rows()], ITEMS)


def test_bounds_are_never_below_the_scores():
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "x"]
    terms = ranked_search.Terms([["a", "bb", "ccc", "x"], ["zz"], ["a", "d"]])
    terms.weigh(300, 9000, np.array([5, 7, 100, 3, 9, 0])[: len(terms.hashes)])
    seen = hits = 0
    for block in ranked_search.blocks_of(pa.array(texts, pa.string())):
        bounds = terms.bounds(np.array(block["sizes"]), np.array(block["most"]), block["slices"])
        scores = terms.scores(pa.array([texts[k] for k in block["rows"]], pa.string()))
        assert (bounds >= scores).all() and len(block["rows"]) <= ranked_search.BLOCK_DOCS
        hits, seen = hits + (scores > 0).sum(), seen + len(block["rows"])
    assert seen == len(texts) and hits
    unsaid = ranked_search.Terms([["yy"]])
    unsaid.weigh(300, 9000, np.array([1]))
    claims = [unsaid.bounds(np.array(b["sizes"]), np.array(b["most"]), b["slices"]) > 0 for b in ranked_search.blocks_of(pa.array(texts, pa.string()))]
    assert sum(c.sum() for c in claims) < 0.05 * len(texts)


def test_very_long_lengths_do_not_overflow():
    terms = ranked_search.Terms([["a"]])
    terms.weigh(10**12, 10**15, np.array([3]))
    assert terms.length_factor(np.array([10**7])).tolist() == [10 + 90 * 10**7 * 10**12 // 10**15]


# 12 spelling variants


def brute_variants(table):
    count = Counter()
    for d, t in table:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = (edits - {w}) & set(n)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def variant_table():
    r = random.Random(8)
    made = ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaabaaa", "straße", "strasse", "straßen", "naïveté", "naiveté", "x" * 3000, "x" * 2999 + "y", "foobar", "foobaz", "fooba", "goobar", "foobarr", "foobarrr", "fo÷bar"]
    made += ["".join(r.choice("abcé") for _ in range(r.randint(6, 8))) for _ in range(150)]
    table = [(i, " ".join(w if i % 2 else w.upper() if w.isascii() else w for w in made for _ in range(1 + (i * len(w)) % 3))) for i in range(8)]
    table += [(100, " ".join(["foobar"] * 900 + ["aaaaaaa"] * 6000 + ["foobarr"] * 200)), (100, "foobaz foobaz-foobaz_foobaz"), (None, "foobar naïveté " * 9), (101, None), (102, ""), (103, "short words only")]
    return table + [(200 + i, f"aaaaaa foobar straße {made[i % len(made)]}") for i in range(600)]


@pytest.mark.parametrize(("points", "asked"), [(100_000, 8192), (400, 16)])
def test_variants_match_brute_force(spark, points, asked, monkeypatch):
    monkeypatch.setattr(spelling, "INDEX_POINTS", points)
    monkeypatch.setattr(spelling, "ASKED", asked)
    table = variant_table()
    corpus = spark.createDataFrame([(*x, "k", 1) for x in table], "doc_id long, text string, word string, n int").repartition(4)
    want = brute_variants(table)
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 3 for w in want)
    assert sorted((tuple(r) for r in spelling.variants(corpus).collect()), key=lambda r: r[0]) == want


def test_variants_of_nothing(none):
    assert spelling.variants(none).collect() == [] and spelling.variants(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_rotations_are_sorted():
    r = np.random.default_rng(2)
    for _ in range(30):
        text = np.concatenate([[0], r.integers(1, 3, r.integers(1, 40))])
        want = sorted(range(len(text)), key=lambda k: [*text[k:], *text[:k]])
        assert spelling._rotations(text).tolist() == want


# 13 quality votes


def test_votes_agree_with_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in quality_knn.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    truth = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    right = {y: sum(p == y for p, q in truth if q == y) / sum(q == y for _, q in truth) for y in (0, 1)}
    assert right[1] >= 0.97 and right[0] >= 0.85


def test_votes_learn_from_no_held_out_label(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = spark.createDataFrame([(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.quality) for r in labels.collect()], "doc_id long, quality int")
    score = lambda which: sorted((r.doc_id, round(r.score, 6)) for r in quality_knn.classify(docs.drop("lang", "source"), which).collect())
    assert score(labels) == score(turned)


def test_votes_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(200, 0), (201, 0), (7777, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = quality_knn.classify(docs, labels).collect()
    assert len(got) == len(rows()) and {r.score for r in got if r.doc_id in (200, 201)} == {0.0}
    assert len({round(r.score, 9) for r in got if r.doc_id in (100, 101)}) == 1
    assert {r.score for r in quality_knn.classify(docs, labels.limit(0)).collect()} == {0.0} and quality_knn.classify(none, labels).collect() == []


def test_votes_are_exact_cosines():
    texts = pa.array([prose(k, 30) for k in range(60)] + ["### $$$ " * 9] * 3)
    labels = np.array([k % 2 for k in range(63)])
    counts = quality_knn.term_counts(texts)
    model = quality_knn.Model(counts, labels, {0: 2.0, 1: 1.0}, np.append((counts > 0).sum(0), 63))
    for text, score in zip(texts.to_pylist()[:9], model.score(texts.slice(0, 9)), strict=True):
        v = quality_knn._unit(quality_knn._weighed(quality_knn.term_counts(pa.array([text])), model.idf) @ model.projection)[0]
        near = sorted(((float(v @ u), k) for k, u in enumerate(model.vectors)), reverse=True)[: quality_knn.NEIGHBOURS]
        votes = [(max(0, c) ** quality_knn.POWER * (1.0 if labels[k] else 2.0), labels[k]) for c, k in near]
        assert score == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=1e-4)
