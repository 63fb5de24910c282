"""Personal data as spans: labelers vote, their reliabilities are learned, a classifier decides.

Candidate spans come from regular expressions, four strict kinds (always kept) and further kinds.
Six labelers vote on every candidate or abstain: the shape, a checksum, gazetteers of prefixes and
endings, words before it that announce it, words before it that speak against it, and its edges.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is,
without labels. The posteriors are soft labels for a logistic regression (Spark ML) over votes and
kinds, and its formula, a column expression, decides on the further kinds.

All of it is DataFrame functions. Matches and the text between them come from ``regexp_extract_all``
and ``split`` with one pattern; positions are sums of their lengths, in code points, by blocks, so a
text with many matches stays near linear; so does the search for overlaps of further spans with base
spans, which looks into the blocks of base spans that a span can meet. The driver sees counts of vote patterns only: at most
3^6 patterns for each kind.

Defined cases: a null text counts as empty; repeated rows are handled each; an empty table gives an
empty result; where no further kind occurs, no classifier is trained. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.storage import materialise

BASE = ("email", "ip", "card", "phone")
#: Patterns never hold a line break. Possessive runs and look-behinds keep them linear; they match what their plain forms match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}(?![0-9A-Za-z-])",
}
KINDS = tuple(PATTERNS)
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "national_id": "-", "account": "", "secret": "", "local_phone": "-"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Endings and prefixes that occur in real addresses, numbers and keys.
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl|pl|us|ca|au|jp|cn|in|br)$",
    "ip": r"^(?!0+\.|127\.|255\.|224\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "account": r"^(AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "secret": r"^(AKIA|gh[pousr]_|sk-)",
    "local_phone": r"^\(?[2-9]",
}
#: Words, in four languages, that stand before personal data or before other numbers.
FOR_WORDS = r"(?i)(mail|correo|courriel|kontakt|contact|tel|phone|call|fax|handy|mobil|llam|appel|card|karte|tarjeta|carte|visa|iban|konto|cuenta|compte|account|ssn|social|key|token|secret|passw|login|user|host|server|\bip\b)[^\n]{0,25}$"
AGAINST_WORDS = r"(?i)(version|\bv|release|isbn|issn|page|seite|section|chapter|kapitel|figure|table|order|invoice|rechnung|total|sum|doi|rfc)[\x20.:#=]{0,3}$"
CONTEXT = 40
BLOCK = 256
VOTES = ("shape", "checksum", "gazetteer", "announced", "contradicted", "edges")
ROUNDS = 60


@dataclass
class Reliability:
    """Chance of a vote "yes" on true and on false candidates, for each labeler, and the share of true ones."""

    share: float
    true: list[float]
    false: list[float]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    value = lambda i: F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
    twice = lambda v: v * 2 - F.when(v > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """Whether a match of a base kind counts; a match of another kind always does."""
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, match: Column, before: Column, after: Column) -> list[Column]:
    """One vote a labeler: true, false, or null to abstain."""
    near = F.right(before, F.lit(CONTEXT))
    yes = lambda c: F.when(c, True)
    checksum = _luhn(_digits(match)) if kind == "card" else F.lit(None).cast("boolean")
    shape = {"email": F.length(match).between(6, 80), "account": F.length(match).between(15, 34), "secret": match.rlike("[0-9]") & match.rlike("[A-Za-z]")}.get(kind, F.lit(True))
    edges = ~(F.right(before, F.lit(1)).rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]"))
    return [shape, checksum, match.rlike(GAZETTEER[kind]), yes(near.rlike(FOR_WORDS)), F.when(near.rlike(AGAINST_WORDS), False), edges]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _found(texts: DataFrame) -> DataFrame:
    """doc_id and, for each kind, the array of valid spans (start, rank, kind, end, votes). Layers stay apart because each value is used twice above."""
    flagged = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digit", F.col("text").rlike("[0-9]"))
    columns: list[Column] = []
    for k in KINDS:
        look = (F.contains("text", F.lit(NEEDS[k])) if NEEDS[k] else F.lit(True)) & (F.lit(True) if k == "email" else F.col("digit"))
        none = F.array().cast("array<string>")
        columns += [F.when(look, F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"m_{k}"), F.when(look, F.split("text", PATTERNS[k], -1)).otherwise(none).alias(f"p_{k}")]
    rows = flagged.select("doc_id", *columns)
    lengths = lambda k: F.zip_with(F.slice(f"p_{k}", F.lit(1), F.size(f"m_{k}")), F.col(f"m_{k}"), lambda p, m: F.length(p) + F.length(m))
    zipped = lambda k: F.arrays_zip(F.col(f"m_{k}").alias("m"), F.slice(f"p_{k}", F.lit(1), F.size(f"m_{k}")).alias("p"), F.slice(f"p_{k}", F.lit(2), F.size(f"m_{k}")).alias("q"))
    rows = rows.select("doc_id", *(c for k in KINDS for c in (zipped(k).cast("array<struct<m:string,p:string,q:string>>").alias(f"z_{k}"), lengths(k).alias(f"l_{k}"))))
    block = lambda k, b: _sum(F.slice(f"l_{k}", b * BLOCK + 1, F.lit(BLOCK)))
    sums = lambda k: F.when(F.size(f"l_{k}") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(f"l_{k}") - 1) / BLOCK).cast("int")), lambda b: block(k, b)))
    rows = rows.select("*", *(sums(k).alias(f"b_{k}") for k in KINDS))
    heads = lambda k: F.when(F.size(f"b_{k}") > 0, F.transform(F.sequence(F.lit(0), F.size(f"b_{k}") - 1), lambda b: _sum(F.slice(f"b_{k}", F.lit(1), b))))
    rows = rows.select("*", *(heads(k).alias(f"h_{k}") for k in KINDS))

    def spans(k: str) -> Column:
        def span(z: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            start = F.get(F.col(f"h_{k}"), b) + _sum(F.slice(f"l_{k}", b * BLOCK + 1, i - b * BLOCK)) + F.length(z["p"])
            return F.struct(start.alias("start"), F.lit(KINDS.index(k)).alias("rank"), F.lit(k).alias("kind"), (start + F.length(z["m"])).alias("end"), F.array(*_votes(k, z["m"], z["p"], z["q"])).alias("votes"), _valid(k, z["m"]).alias("valid"))

        made = F.when(F.size(f"h_{k}") > 0, F.transform(f"z_{k}", span))
        return F.filter(F.coalesce(made, F.array().cast(_SPANS)), lambda s: s["valid"])

    return rows.select("doc_id", *(spans(k).alias(k) for k in KINDS))


_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,votes:array<boolean>,valid:boolean>>"


def _candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and extra: sorted spans of the base kinds, and of the further kinds where no base span overlaps."""
    rows = _found(docs)
    rows = rows.select("doc_id", F.array_sort(F.concat(*BASE)).alias("base"), F.array_sort(F.concat(*KINDS[len(BASE) :])).alias("extra"))
    part = lambda b: F.slice("base", b * BLOCK + 1, F.lit(BLOCK))
    low = lambda b: F.get("base", b * BLOCK)["start"]
    high = lambda b: F.array_max(F.transform(part(b), lambda s: s["end"]))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("base") - 1) / BLOCK).cast("int")), lambda b: F.struct(b.alias("b"), low(b).alias("low"), high(b).alias("high")))
    rows = rows.withColumn("blocks", F.when((F.size("base") > 0) & (F.size("extra") > 0), blocks))
    meets = lambda e: F.exists("blocks", lambda k: (k["low"] < e["end"]) & (e["start"] < k["high"]) & F.exists(part(k["b"]), lambda s: (s["start"] < e["end"]) & (e["start"] < s["end"])))
    return rows.select("doc_id", "base", F.when(F.col("blocks").isNotNull(), F.filter("extra", lambda e: ~meets(e))).otherwise(F.col("extra")).alias("extra"))


def learn(patterns: list[tuple[list[bool | None], int]]) -> Reliability:
    """Expectation-maximisation over (votes, count): candidates are true or false, and votes independent given that."""
    n = len(VOTES)
    out = Reliability(0.8, [0.8] * n, [0.4] * n)
    for _ in range(ROUNDS):
        total = sure = 0.0
        true, false = [[1.6, 2.0] for _ in range(n)], [[0.8, 2.0] for _ in range(n)]  # pseudo-counts: votes "yes", votes
        for votes, count in patterns:
            q = posterior(out, votes)
            total, sure = total + count, sure + count * q
            for i, v in enumerate(votes):
                if v is not None:
                    for rates, weight in ((true, count * q), (false, count * (1 - q))):
                        rates[i][0] += weight * v
                        rates[i][1] += weight
        rates = [[min(max(a / b, 0.01), 0.99) for a, b in side] for side in (true, false)]
        # a "yes" never speaks against a candidate
        out = Reliability(min(max((sure + 1.6) / (total + 2), 0.01), 0.99), rates[0], [min(f, t) for t, f in zip(*rates, strict=True)])
    return out


def posterior(r: Reliability, votes: list[bool | None]) -> float:
    odds = math.log(r.share / (1 - r.share))
    for v, t, f in zip(votes, r.true, r.false, strict=True):
        if v is not None:
            odds += math.log(t / f) if v else math.log((1 - t) / (1 - f))
    return 1 / (1 + math.exp(-odds))


def _posterior(r: Reliability, votes: str) -> Column:
    """``posterior`` as a column expression."""
    terms = [F.when(F.get(votes, F.lit(i)), math.log(t / f)).when(~F.get(votes, F.lit(i)), math.log((1 - t) / (1 - f))).otherwise(0.0) for i, (t, f) in enumerate(zip(r.true, r.false, strict=True))]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(math.log(r.share / (1 - r.share))))))


def _features(kind: Column, votes: Column) -> list[Column]:
    """Each vote as -1, 0 or 1, and the kind as flags."""
    return [F.when(F.get(votes, F.lit(i)), 1.0).when(~F.get(votes, F.lit(i)), -1.0).otherwise(0.0) for i in range(len(VOTES))] + [F.when(kind == k, 1.0).otherwise(0.0) for k in KINDS]


def _classifier(counted: DataFrame) -> tuple[float, list[float]] | None:
    """Intercept and weights of the span classifier, trained on all candidates, a row for each kind and vote pattern."""
    patterns = [(list(r["votes"]), r["n"]) for r in counted.groupBy("votes").agg(F.sum("n").alias("n")).collect()]
    if not patterns:
        return None
    soft = counted.withColumn("p", _posterior(learn(patterns), "votes"))
    names = [f"f{i}" for i in range(len(VOTES) + len(KINDS))]
    features = [c.alias(n) for c, n in zip(_features(F.col("kind"), F.col("votes")), names, strict=True)]
    both = soft.select(*features, F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))).alias("s")).select(*names, "s.*")
    model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=50).fit(VectorAssembler(inputCols=names, outputCol="features").transform(both.coalesce(1)))
    return float(model.intercept), [float(x) for x in model.coefficients.toArray()]


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 over the base spans, spans (all, as kind:start:end by start and kind)."""
    rows = materialise(_candidates(docs), "pii-candidates")
    counted = rows.select(F.explode(F.concat("base", "extra")).alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n"))
    model = _classifier(materialise(counted, "pii-patterns"))
    chosen = F.array().cast(_SPANS)
    if model is not None:
        intercept, weights = model
        score = lambda s: reduce(lambda a, b: a + b, (f * w for f, w in zip(_features(s["kind"], s["votes"]), weights, strict=True)), F.lit(intercept))
        chosen = F.filter("extra", lambda s: score(s) >= 0)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", chosen))).alias("spans"))
