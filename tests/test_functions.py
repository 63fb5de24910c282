"""Column functions: hashing, text, triage, routing, validation, statistics."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, objects, scoring, stats, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tenants_and_split(spark):
    rows = spark.range(1, 10_001).select("id", hashing.tenant_of(F.col("id")).alias("t"), hashing.is_held_out(F.col("id")).alias("h")).collect()
    digest = lambda s: int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big")
    assert all(r.t == digest(f"tenant:{r.id}") % 50 and r.h == (digest(f"heldout:{r.id}") % 10 == 0) for r in rows)
    assert {r.t for r in rows if r.id < 2000} == set(range(50)) and 0.07 < sum(r.h for r in rows) / 10_000 < 0.13


def test_fingerprint_sees_every_change(spark):
    df = lambda rows: spark.createDataFrame(rows, "k int, t string")
    prints = {tuple(hashing.fingerprint(df(r), "k", "t").first()) for r in ([(1, "a")], [(1, "b")], [(2, "a")], [(1, "a"), (1, "a")], [(1, None)], [])}
    assert len(prints) == 6
    base = hashing.check_fingerprint(df([(1, "a"), (2, "b")]), "k", "t", None)
    assert hashing.check_fingerprint(df([(2, "b"), (1, "a")]), "k", "t", base) == base
    with pytest.raises(ValueError):
        hashing.check_fingerprint(df([(2, "b")]), "k", "t", base)


@pytest.mark.parametrize(
    ("body", "want"),
    [("![x](a.png)", True), ("see https://user-images.githubusercontent.com/1/2.png", True), ("github.com/user-attachments/assets/1", True), ('<img src="a">', True), ("plain [x](y)", False), ("", False), (None, False)],
)
def test_has_images(spark, body, want):
    assert one(spark, text.has_images(F.lit(body).cast("string")).alias("x")).x is want


def test_texts(spark):
    body = "before\n```\nlog log\n```\nafter"
    r = one(
        spark, text.embed_text(F.lit(" T "), F.lit(body)).alias("e"), F.length(text.embed_text(F.lit("T"), F.lit("x" * 5000))).alias("n"), text.captioned_embed_text(F.lit("t" * 300), F.lit("b" * 2000), F.lit("c" * 900)).alias("c"),
        text.captioned_embed_text(F.lit("t"), F.lit(None).cast("string"), F.lit("")).alias("d"), text.strip(F.lit(" \n x y  ")).alias("s"), text.image_refs(F.lit('![a](1.png) <img src="3.png"> {{< figure src="2.png" >}} ![b](1.png)')).alias("i"),
        text.image_urls(F.lit("![a](https://x/1) ![b](https://x/1) <img src='https://x/2'> ![c](https://x/3) ![d](https://x/4)")).alias("u"), text.query_text(F.lit("t"), F.lit("b" * 900)).alias("q"),
    )
    assert r.e == "T \n\nbefore\n \nafter" and r.n == 1600 and r.s == "x y"
    assert r.c == "t" * 200 + "\n\nImage content: " + "c" * 400 + "\n\n" + "b" * 1200 and r.d == "t"
    assert r.i == ["1.png", "1.png", "2.png", "3.png"] and r.u == ["https://x/1", "https://x/3", "https://x/4"] and r.q == "t\n" + "b" * 500


def test_triage(spark):
    t = lambda s: one(spark, scoring.triage(F.lit(s)).alias("t")).t
    r = t("conntrack table of the service network fails")
    assert (r.component, r.severity, r.matched_terms, r.confidence) == ("sig/network", "medium", ["conntrack", "network", "service"], 1.0)
    assert t("PANIC in csi mount").severity == "high" and t("PANIC in csi mount").component == "sig/storage"
    assert (t("hello").component, t("hello").confidence, t("hello").severity) == ("unknown", 0.0, "low")
    assert t("dns taint").component == "sig/scheduling" and t("dns taint").confidence == round(0.5 / 3, 3)


@pytest.mark.parametrize(
    ("triage", "retrieval", "cited", "chars", "degraded", "sufficiency", "want"),
    [
        (0.65, 0.65, True, 500, False, None, ("auto_attach", 0.65)), (0.9, 0.9, True, 79, True, None, ("request_info", 0.9)), (0.9, 0.9, True, 80, True, 1, ("escalate", 0.69)), (0.9, 0.9, True, 500, False, 2, ("request_info", 0.75)),
        (0.9, 0.9, False, 500, False, None, ("escalate", 0.9)), (0.3, 0.3, True, 500, False, None, ("request_info", 0.3)), (0.35, 0.35, True, 500, False, None, ("escalate", 0.35)), (0.8, 0.6, True, 500, False, None, ("auto_attach", 0.7)),
        (0.5, 0.5, True, 500, False, 5, ("auto_attach", 0.65)),
    ],
)
def test_routing(spark, triage, retrieval, cited, chars, degraded, sufficiency, want):
    r = one(spark, scoring.route(F.lit(triage), F.lit(retrieval), F.lit(cited), F.lit(chars), F.lit(degraded), F.lit(sufficiency).cast("int")).alias("r")).r
    assert (r.route, r.confidence) == want


def test_outcomes(spark):
    rows = [(200, None, False), (200, None, True), (503, None, False), (404, None, True), (0, None, False), (None, "reset", False)]
    df = spark.createDataFrame(rows, "s int, e string, d boolean").coalesce(1)
    assert [r.c for r in df.select(scoring.outcome(F.col("s"), F.col("e"), F.col("d")).alias("c")).collect()] == ["llm_ok", "degraded_ok", "server_error", "client_error", "transport_error", "transport_error"]


@pytest.mark.parametrize(
    ("json", "error"),
    [
        ('{"context_sufficiency": 4, "probable_cause": "c", "suggested_fix": "f", "citations": [{"source": "a", "quote": "q"}]}', None), ('{"context_sufficiency": 2, "probable_cause": "c", "suggested_fix": "f", "citations": []}', None), ('{"context_sufficiency": 3, "citations": []}', "uncited"), ('{"citations": []}', "bad sufficiency"),
        ('{"context_sufficiency": true}', "bad sufficiency"), ('{"context_sufficiency": "4/5"}', "bad sufficiency"), ('{"context_sufficiency": 4.5}', "bad sufficiency"), ('{"context_sufficiency": 9}', "bad sufficiency"),
        ('{"context_sufficiency": 4, "citations": [{"source": "z", "quote": "q"}]}', "citation outside the context"), ("not json", "no object"),
        ('{"context_sufficiency": 2, "probable_cause": "c", "citations": []}', "no cause or fix"), ('{"context_sufficiency": 2, "probable_cause": "", "suggested_fix": "f"}', "no cause or fix"), ('{"context_sufficiency": 2, "probable_cause": "c", "suggested_fix": null}', "no cause or fix"),
        ('{"context_sufficiency": 2, "probable_cause": false, "suggested_fix": "f"}', "no cause or fix"), ('{"context_sufficiency": 2, "probable_cause": 0, "suggested_fix": "f"}', "no cause or fix"), ('{"context_sufficiency": 2, "probable_cause": "0", "suggested_fix": "false"}', None),
    ],
)
def test_draft_validation(spark, json, error):
    r = one(spark, scoring.valid_draft(F.lit(json), F.array(F.lit("a"), F.lit("b"))).alias("r")).r
    assert r.error == error


@pytest.mark.parametrize(("value", "ok"), [("3", True), ("0", False), ("6", False), ('"4"', False), ("true", False), ("2.5", False), ("null", False)])
def test_score_validation(spark, value, ok):
    r = one(spark, scoring.valid_scores(F.lit(f'{{"a": {value}, "b": 5}}'), ["a", "b"]).alias("r")).r
    assert (r.error is None) is ok and r.b == 5


def test_triage_validation(spark):
    f = lambda j: one(spark, scoring.valid_triage(F.lit(j), ["sig/a"]).alias("r")).r
    r = f('{"component": "sig/a", "severity": "high", "evidence": ["1","2","3","4","5","6","7"], "confidence": 1.7}')
    assert r.error is None and r.severity == "high" and len(r.terms) == 6 and r.confidence == 1.0 and f('{"component": "sig/z"}').error is not None
    r = f('{"component": "sig/a"}')
    assert (r.error, r.severity, r.terms, r.confidence) == (None, "low", [], 0.0)
    assert f('{"component": "sig/a", "confidence": "0.5"}').confidence == 0.5
    assert [f(f'{{"component": "sig/a", "confidence": {x}}}').error for x in ('"sure"', "null", "[1]")] == ["confidence is no number"] * 3
    assert f('{"component": "sig/a", "evidence": 3}').error == "evidence is no list"


def test_percentiles(spark):
    df = spark.range(1, 16).select(F.col("id").cast("double").alias("v"))
    r = stats.report_percentiles(df, "v").first()
    assert r.p50 == 8 and r.p95 is None and r.p99 is None and r.max == 15
    assert df.agg(stats.percentile("v", 95).alias("p")).first().p == pytest.approx(14.3)
    assert spark.range(1, 5).agg(stats.percentile("id", 50).alias("p")).first().p == 2.5
    with pytest.raises(ValueError):
        stats.percentile("v", 101)


@pytest.mark.parametrize("small", [20_000, 40, 0])
def test_percentiles_of_large_groups(spark, small, monkeypatch):
    """Equal to the built-in, whatever has to be cut again: ties, heavy tails, one value, nulls and a null group."""
    monkeypatch.setattr(stats, "SMALL", small)
    r = __import__("random").Random(3)
    rows = [("normal", r.gauss(0, 1)) for _ in range(3000)] + [("tail", 10.0 ** r.uniform(-200, 200)) for _ in range(900)] + [("ties", float(r.choice([1, 2, 2, 2, 3]))) for _ in range(1500)] + [("one", 7.0)] * 500
    rows += [(None, float(i)) for i in range(21)] + [("few", 3.5), ("few", None), ("few", float("nan")), ("few", -1.0), ("none", None), ("hot", 0.0)] + [("hot", 5.0)] * 4000 + [("hot", 5.0 + i * 1e-12) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    points = (0, 12.5, 50, 95, 99, 100)
    got = {x.k: x for x in stats.percentiles(df, "v", points, "k").collect()}
    want = {x.k: x for x in df.where("NOT isnan(v)").groupBy("k").agg(F.count("v").alias("n"), F.max("v").alias("max"), *(F.percentile("v", p / 100).alias(f"p{p}") for p in points)).collect()}
    assert set(got) == {k for k, x in want.items() if x.n}
    for k, x in got.items():
        assert (x.n, x["max"]) == (want[k].n, want[k]["max"]) and all(x[f"p{p}"] == pytest.approx(want[k][f"p{p}"], rel=1e-12) for p in points), k
    whole = stats.percentiles(df, "v", (50,)).first()
    assert whole.n == df.where("v IS NOT NULL AND NOT isnan(v)").count() and stats.percentiles(df.limit(0), "v", (50,), "k").count() == 0
    with pytest.raises(ValueError):
        stats.percentiles(df, "v", (101,))


@pytest.mark.parametrize(("b", "a"), [(0, 0), (5, 1), (1, 5), (20, 9), (200, 150)])
def test_mcnemar(spark, b, a):
    rows = [(i, True, False) for i in range(b)] + [(1000 + i, False, True) for i in range(a)] + [(5000, True, True)]
    df = spark.createDataFrame(rows, "k int, x boolean, y boolean")
    r = stats.mcnemar(df.select("k", F.col("x").alias("hit")), df.select("k", F.col("y").alias("hit")), "k", "hit").first()
    n, k = a + b, min(a, b)
    want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    assert (r.n_pairs, r.base_only, r.arm_only) == (n + 1, b, a) and r.p_value == pytest.approx(want)


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1)] * 6 + [(2, 2)] * 3 + [(1, 2)] * 3, "a int, b int")
    r = stats.kappa(df, "a", "b").first()
    assert r.n == 12 and r.kappa == pytest.approx((9 / 12 - (9 * 6 + 3 * 6) / 144) / (1 - (9 * 6 + 3 * 6) / 144))
    assert stats.kappa(df.limit(5), "a", "b").first().kappa is None
    assert stats.kappa(spark.createDataFrame([(1, 1)] * 12, "a int, b int"), "a", "b").first().kappa == 1.0


def test_registered_bootstrap_takes_all_draws(spark, sf_dir):
    from tidemark.plans import evaluating, tables

    want = stats.bootstrap(tables.table(spark, sf_dir, "labels"), "quality", draws=2000).first()
    assert evaluating.bootstrap(spark, sf_dir).first() == want


def test_bootstrap_of_equal_rows(spark):
    ones = spark.range(1000).select((F.col("id") % 2).cast("int").alias("v"))
    r = stats.bootstrap(ones, "v")
    low, high = r.first()
    assert 0.455 < low < 0.48 and 0.52 < high < 0.545 and stats.bootstrap(ones.repartition(7), "v").first() == (low, high)
    assert stats.bootstrap(ones.limit(0), "v").first().low is None and stats.bootstrap(ones.where("v = 1"), "v").first() == (1.0, 1.0)


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 2).alias("v"))
    r = stats.bootstrap(df, "v", draws=200).first()
    assert 0.4 < r.low < 0.5 < r.high < 0.6


@pytest.mark.parametrize(
    ("response", "want"),
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'), ('x {} then {"b": "}"} y', '{"b": "}"}'), ('{"q": "a \\" {"} {"c": 1}', '{"q": "a \\" {"}'), ("{broken} {\"d\": [1, {\"e\": 2}]}", '{"d": [1, {"e": 2}]}'), ("none", None), ('{"open": 1', None), (None, None), ("", None),
    ],
)
def test_first_object(spark, response, want):
    assert one(spark, objects.first_object(F.lit(response).cast("string")).alias("o")).o == want
