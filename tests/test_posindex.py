"""The kept positional index against plain searches and a brute-force cover density."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fulltext, posindex, topk

WORDS = ["pod", "node", "volume", "dns", "mount", "the", "running", "pods", "leak"]


def table(n=900, seed=3):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(WORDS[: 3 + i % 7]) for _ in range(r.randint(0, 12) if i % 50 else 200)), i % 3 if i % 11 else None) for i in range(n)]
    return rows + [(n, None, 1), (n + 1, "", 1), (n + 2, "  The the ", 2), (n + 3, "DNS!dns_dns é dns", None)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(table(), "key long, text string, tenant_id int").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    kept = posindex.KeptIndex(spark, str(tmp_path_factory.mktemp("index")))
    kept.append(corpus.where("key < 700"), 0, "tenant_id").append(corpus.where("key >= 700"), 1, "tenant_id")
    return kept.append(corpus.where("key >= 700"), 1, "tenant_id")  # a generation written again replaces itself


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, ["pod", "node"], 1), (2, ["leak"], 2), (3, [], 1), (4, ["nowhere"], 1), (5, ["dns", "pod", "volume"], 0), (6, None, 1), (7, ["dns", "dns"], 1), (8, ["mount", "leak"], None)]
    return spark.createDataFrame(rows, "query_id long, terms array<string>, tenant_id int")


@pytest.mark.parametrize("sent_rows", [8192, 0])
@pytest.mark.parametrize(("mode", "same"), [("any", False), ("all", False), ("any", True), ("all", True)])
def test_index_equals_the_scan(index, asked, corpus, mode, same, sent_rows, monkeypatch):
    once = asked.withColumn("terms", F.array_distinct("terms"))
    want = sorted(map(tuple, fulltext.match(once, corpus, 7, mode, same).collect()))
    monkeypatch.setattr(topk, "SENT_ROWS", sent_rows)
    assert sorted(map(tuple, index.search(asked, 7, mode, same).collect())) == want and want


def test_blocks_are_skipped(index, asked):
    blocks = index.blocks()
    terms = asked.select("query_id", F.lit(0).alias("g"), F.size("terms").alias("n_terms"), F.explode("terms").alias("token")).where("query_id = 1")
    zones, _, rest = posindex.chosen(terms, blocks, 5, False, False)
    n, read = zones.agg(F.sum("n_blocks")).first()[0], zones.where(F.col("place") <= posindex.FIRST).agg(F.sum("n_blocks")).first()[0] + (rest.agg(F.sum("n_blocks")).first()[0] or 0)
    assert n == blocks.where("token IN ('pod', 'node')").count() and read < n


def test_a_session_finds_the_index_again(spark, index, asked, corpus):
    again = posindex.KeptIndex(spark.newSession(), index.folder)
    assert again.blocks().count() == index.blocks().count() > 0
    assert index.blocks().agg(F.max("n"), F.sum("n")).first()[0] <= posindex.ZONE


def test_stemmed_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "pods are running"), (2, "a pod runs"), (3, "policies")], "key long, text string")
    kept = posindex.KeptIndex(spark, str(tmp_path / "i"), stem=True).append(docs, 0)
    asked = spark.createDataFrame([(1, ["pods", "pod", "run"]), (2, ["policy"])], "query_id long, terms array<string>")
    assert sorted((r.query_id, r.key, r.hits) for r in kept.search(asked).collect()) == [(1, 1, 2), (1, 2, 2), (2, 3, 1)]
    typed = spark.createDataFrame([(1, '"pod running"'), (2, '"pods are run" -policy')], "query_id long, text string")
    assert sorted((r.query_id, r.key) for r in kept.cover(typed).collect()) == [(1, 2), (2, 1)]


@pytest.mark.parametrize(
    ("typed", "want"),
    [
        ("Pod node", [(0, False, [("pod", 0)]), (0, False, [("node", 0)])]), ('"the pod is down" -leak', [(0, False, [("pod", 1), ("down", 3)]), (0, True, [("leak", 0)])]), ("the of", []), (None, []), ("a or b2 OR c3", [(1, False, [("b2", 0)]), (2, False, [("c3", 0)])]),
        ("kube-proxy", [(0, False, [("kube", 0), ("proxy", 1)])]), ('-"x y" z"', [(0, True, [("x", 0), ("y", 1)]), (0, False, [("z", 0)])]), ('""', []),
    ],
)
def test_parsing(spark, typed, want):
    got = spark.range(1).select(posindex.parse(F.lit(typed).cast("string")).alias("u")).first().u
    assert [(u.alternative, u.negated, [(w.token, w.place) for w in u.words]) for u in got] == want


def brute(units, words):
    """Cover density by trying all spans."""
    def holds(u, a, z):
        return any(all(words[s + w["place"] - u["words"][0]["place"]] == w["token"] for w in u["words"]) for s in range(a, z + 1) if s + u["words"][-1]["place"] - u["words"][0]["place"] <= z)

    n = len(words)
    ok = [a for a in {u["alternative"] for u in units} if any(not u["negated"] for u in units if u["alternative"] == a) and all(holds(u, 0, n - 1) != u["negated"] for u in units if u["alternative"] == a)]
    good = [(a, z) for a in range(n) for z in range(a, n) if any(all(holds(u, a, z) for u in units if u["alternative"] == k and not u["negated"]) for k in ok)]
    least = [(a, z) for a, z in good if not any((b, y) != (a, z) and a <= b and y <= z for b, y in good)]
    asked = {w["token"] for u in units if not u["negated"] for w in u["words"]}
    return sum(1 / (1 + sum(w not in asked for w in words[a : z + 1])) for a, z in least)


def test_density_matches_brute_force():
    r = random.Random(5)
    unit = lambda a, k, neg, *words: {"alternative": a, "unit": k, "negated": neg, "words": [{"token": t, "place": p} for t, p in words]}
    queries = [
        [unit(0, 0, False, ("a", 0)), unit(0, 1, False, ("b", 0))], [unit(0, 0, False, ("a", 0), ("b", 1))], [unit(0, 0, False, ("a", 1), ("a", 3)), unit(0, 1, False, ("c", 0))], [unit(0, 0, False, ("a", 0)), unit(0, 1, True, ("b", 0), ("c", 1))],
        [unit(0, 0, False, ("a", 0)), unit(0, 1, False, ("b", 0)), unit(1, 2, False, ("c", 0), ("c", 1))], [unit(0, 0, True, ("a", 0))], [unit(k, k, False, (t, 0)) for k, t in enumerate("abc")], [unit(0, 0, False, ("a", 0)), unit(0, 1, False, ("a", 0), ("b", 1)), unit(0, 2, False, ("c", 0))],
    ]
    for units, _ in itertools.product(queries, range(60)):
        words = [r.choice("abcd") for _ in range(r.randint(0, 14))]
        spots = {}
        for i, w in enumerate(words):
            spots.setdefault(w, []).append(i)
        assert posindex.density(units, spots) == pytest.approx(brute(units, words))


def test_cover_ranks_near_words_first(spark, corpus, index):
    typed = spark.createDataFrame([(1, "pod leak", 1), (2, '"pod node" -dns', 2), (3, "-pod", 1), (4, None, 1), (5, "mount or leak", 0)], "query_id long, text string, tenant_id int")
    for same in (False, True):
        got = sorted(map(tuple, index.cover(typed, 5, same).collect()))
        want = []
        for q in typed.collect():
            units = [u.asDict(True) for u in spark.range(1).select(posindex.parse(F.lit(q.text).cast("string")).alias("u")).first().u]
            found = []
            for key, text, tenant in table():
                words = [w for w in __import__("re").split(r"[^a-z0-9_]+", (text or "").lower()) if w]
                spots = {}
                for i, w in enumerate(words):
                    spots.setdefault(w, []).append(i)
                score = posindex.density(units, spots) if units else 0
                if score > 0 and (not same or tenant == q.tenant_id):
                    found.append((-round(score, 9), key))
            want += [(q.query_id, key, -s, i + 1) for i, (s, key) in enumerate(sorted(found)[:5])]
        assert [(a, b, round(c, 8), d) for a, b, c, d in got] == [(a, b, round(c, 8), d) for a, b, c, d in sorted(want)] and want


def test_empty_index(spark, tmp_path, asked):
    docs = spark.createDataFrame([], "key long, text string")
    kept = posindex.KeptIndex(spark, str(tmp_path / "i")).append(docs, 0)
    assert kept.search(asked).collect() == [] and kept.cover(spark.createDataFrame([(1, "pod")], "query_id long, text string")).collect() == []


def test_a_zone_has_the_density_of_each_text(spark):
    r = random.Random(11)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 40))) for _ in range(120)]
    rows = posindex._blocks(3, pa.array(range(120), pa.int64()), pa.array([i % 2 if i % 7 else None for i in range(120)], pa.int64()), pa.array(texts), False)
    typed = ["pod", "pod node", '"pod node" dns', 'dns -"pod volume"', "pod volume OR dns leak -mount", '"volume the dns" OR running', "nowhere OR leak", "-pod"]
    parsed = [[u.asDict(True) for u in spark.range(1).select(posindex.parse(F.lit(q)).alias("u")).first().u] for q in typed]
    for units in parsed:
        alternatives = {}
        for u in units:
            alternatives.setdefault(u["alternative"], ([], []))[u["negated"]].append(tuple((w["token"], w["place"]) for w in u["words"]))
        words = sorted({w["token"] for u in units if not u["negated"] for w in u["words"]})
        zone = posindex._Zone(rows, 4)
        docs, score = zone.density(list(alternatives.values()), words, None)
        got = dict(zip(zone.keys[docs].tolist(), score.tolist(), strict=True))
        for key, text in enumerate(texts):
            spots = {}
            for i, w in enumerate(text.split()):
                spots.setdefault(w, []).append(i)
            assert got.get(key, 0.0) == pytest.approx(posindex.density(units, spots)), (units, text)


@pytest.mark.parametrize("mode", ["any", "all"])
def test_no_pair_of_query_and_document_is_a_row(index, asked, mode):
    """Postings of a sent batch are not exploded and not grouped by query and document."""
    assert "explode" not in index.search(asked, 7, mode)._jdf.queryExecution().toString()


def test_covered_postings_stay_in_their_zone(spark, index):
    typed = spark.createDataFrame([(1, "pod node"), (2, 'dns OR "leak pod"')], "query_id long, text string")
    plan = index.cover(typed, 5)._jdf.queryExecution().toString()
    assert "explode" not in plan and "MapInArrow" in plan


def test_building_an_index_runs_once(spark, corpus):
    """Blocks are not dealt out after they are made, for which a range of them would be sampled by making all twice."""
    plan = posindex.build(corpus)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("rangepartitioning") and plan.count("rangepartitioning") == 1
