"""Classification, routing and validation as column expressions; they work on batches and streams alike."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from tidemark.functions.text import strip

#: Thresholds of the blended confidence, and the shortest body.
AUTO_ATTACH, REQUEST_INFO, LEAST_BODY = 0.65, 0.35, 80
#: Terms of each component, and of the two upper severities.
COMPONENT_TERMS = {
    "sig/network": ("service", "ingress", "dns", "kube-proxy", "endpoint", "network", "cidr", "dual-stack", "loadbalancer", "nodeport", "conntrack", "cni", "netpol"),
    "sig/scheduling": ("schedul", "preempt", "affinity", "taint", "toleration", "topology spread", "priority", "bind", "queuehint", "nodename"),
    "sig/storage": ("volume", "pvc", "persistentvolume", "csi", "mount", "storageclass", "attach", "detach", "nfs", "iscsi", "snapshot"),
}
HIGH_TERMS = ("panic", "crash", "data loss", "corrupt", "cve-", "deadlock", "delete")
MEDIUM_TERMS = ("leak", "degrad", "stuck", "fail", "timeout", "race", "error")
ROUTES = ("auto_attach", "escalate", "request_info")


def _terms(terms: Sequence[str]) -> Column:
    return F.array(*map(F.lit, terms))


def triage(text: Column, components: Mapping[str, Sequence[str]] = COMPONENT_TERMS, high: Sequence[str] = HIGH_TERMS, medium: Sequence[str] = MEDIUM_TERMS) -> Column:
    """struct(component, severity, matched_terms, confidence) by terms held in the lower-cased text.

    The component with most terms wins, the greater name on ties; confidence is its share of all
    found terms, damped below three terms.
    """
    low = F.lower(text)
    holds = lambda terms: F.filter(_terms(terms), lambda t: F.contains(low, t))
    found = F.array(*(F.struct(F.size(holds(t)).alias("n"), F.lit(c).alias("name"), F.array_sort(holds(t)).alias("terms")) for c, t in components.items()))
    total = F.aggregate(found, F.lit(0), lambda a, x: a + x["n"])
    best = F.array_max(found)
    confidence = F.round(F.try_divide(best["n"], total) * F.least(F.lit(1.0), best["n"] / 3), 3)
    severity = F.when(F.exists(_terms(high), lambda t: F.contains(low, t)), "high").when(F.exists(_terms(medium), lambda t: F.contains(low, t)), "medium").otherwise("low")
    none = best["n"] == 0
    return F.struct(F.when(none, "unknown").otherwise(best["name"]).alias("component"), severity.alias("severity"), best["terms"].alias("matched_terms"), F.when(none, 0.0).otherwise(confidence).alias("confidence"))


def degraded(stages: Mapping[str, Column]) -> Column:
    """struct(degraded, stages) of independent failure flags by stage: any of them degrades the response, and all that hold are kept as reasons. The route sees the flag of the draft alone."""
    reasons = F.array_compact(F.array(*(F.when(flag, F.lit(name)) for name, flag in stages.items())))
    return F.struct((F.size(reasons) > 0).alias("degraded"), reasons.alias("stages"))


def served_draft(checked: Column, drafted: Column, extractive: Column) -> Column:
    """struct(body, source): the drafted answer if its check (``valid_draft``) found no error, else the extractive one."""
    ok = drafted.isNotNull() & checked["error"].isNull()
    return F.struct(F.when(ok, drafted).otherwise(extractive).alias("body"), F.when(ok, "model").otherwise("extractive").alias("source"))


def route(triage_confidence: Column, retrieval_confidence: Column, has_citations: Column, body_chars: Column, degraded: Column, sufficiency: Column) -> Column:
    """struct(route, confidence, rule): hard rules in order, then thresholds on the blended, rounded confidence."""
    confidence = F.round(F.when(sufficiency.isNull(), 0.5 * triage_confidence + 0.5 * retrieval_confidence).otherwise(0.4 * triage_confidence + 0.3 * retrieval_confidence + 0.3 * sufficiency / 5), 3)
    rules = (
        (body_chars < LEAST_BODY, "request_info", "short body"),
        (degraded, "escalate", "degraded"),
        (sufficiency <= 2, "request_info", "insufficient context"),
        (~has_citations, "escalate", "no citations"),
        (confidence >= AUTO_ATTACH, "auto_attach", "confident"),
        (confidence < REQUEST_INFO, "request_info", "unsure"),
    )
    to, why = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, target, rule in rules[1:]:
        to, why = to.when(test, target), why.when(test, rule)
    return F.struct(to.otherwise("escalate").alias("route"), confidence.alias("confidence"), why.otherwise("in between").alias("rule"))


def reasons(triage_confidence: Column, retrieval_confidence: Column, sufficiency: Column, decision: Column) -> Column:
    """The inputs and the rule that decided, as an array of texts."""
    return F.array(
        F.format_string("triage_confidence=%.2f", triage_confidence), F.format_string("retrieval_confidence=%.2f", retrieval_confidence),
        F.concat(F.lit("context_sufficiency="), F.coalesce(sufficiency.cast("string"), F.lit("None"))), decision["rule"],
    )


def outcome(status: Column, error: Column, degraded: Column) -> Column:
    """Class of a logged request; errors of the transport, the server and the caller stay apart."""
    return F.when(error.isNotNull() | status.isNull() | (status == 0), "transport_error").when(status >= 500, "server_error").when(status >= 400, "client_error").when(degraded, "degraded_ok").otherwise("llm_ok")


def protocol_checks(status: Column, to: Column, degraded: Column, expected_degraded: Column) -> Column:
    """struct of booleans: status 200, a known route, and the degraded flag where an arm expects one."""
    return F.struct((status == 200).alias("status_ok"), F.coalesce(to.isin(*ROUTES), F.lit(False)).alias("route_ok"), (expected_degraded.isNull() | (degraded == expected_degraded)).alias("arm_ok"))


_KIND = lambda v: F.schema_of_variant(v)


def _integer(json: Column, path: str) -> Column:
    """The value at a path if it is a whole JSON number (no boolean, text or fraction), else null."""
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.when(_KIND(value).isin("BIGINT", "INT"), F.try_variant_get(F.try_parse_json(json), path, "int"))


def _truthy(value: Column, path: str) -> Column:
    """The value at a path as a text, null if it is missing, null, empty, false or zero."""
    text = F.try_variant_get(value, path, "string")
    kind = _KIND(F.try_variant_get(value, path, "variant"))
    nothing = (text == "") | (kind.startswith("BOOLEAN") & (text == "false")) | (kind.rlike("INT|DECIMAL|DOUBLE|FLOAT") & (F.try_variant_get(value, path, "double") == 0)) | text.isin("[]", "{}")
    return F.when(~nothing, text)


def valid_triage(json: Column, components: Sequence[str]) -> Column:
    """struct(component, severity, terms, confidence, error) of a classifier's answer.

    Unknown components, evidence that is no list and a confidence that is no number (a number in quotes
    is one) are errors. A missing severity is low, missing evidence empty, a missing confidence 0. Terms
    are cut to 6, confidence to [0, 1].
    """
    v = F.try_parse_json(json)
    name = F.try_variant_get(v, "$.component", "string")
    listed, said = F.try_variant_get(v, "$.evidence", "array<string>"), F.try_variant_get(v, "$.confidence", "double")
    given = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    terms = F.slice(F.coalesce(listed, F.array().cast("array<string>")), 1, 6)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(said, F.lit(0.0))))
    severity = F.when(given("$.severity"), F.try_variant_get(v, "$.severity", "string")).otherwise("low")
    ok = F.coalesce(name.isin(*components), F.lit(False))
    error = F.when(~ok, "component is not allowed").when(given("$.evidence") & listed.isNull(), "evidence is no list").when(given("$.confidence") & said.isNull(), "confidence is no number")
    return F.struct(name.alias("component"), severity.alias("severity"), terms.alias("terms"), confidence.alias("confidence"), error.alias("error"))


def valid_scores(json: Column, names: Sequence[str]) -> Column:
    """struct of whole scores 1 to 5 and an error; values are never clamped."""
    values = [_integer(json, f"$.{n}") for n in names]
    bad = F.array_compact(F.array(*(F.when(v.isNull() | ~v.between(1, 5), n) for v, n in zip(values, names, strict=True))))
    return F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)), F.when(F.size(bad) > 0, F.concat(F.lit("bad "), F.array_join(bad, ", "))).alias("error"))


def valid_draft(json: Column, allowed: Column) -> Column:
    """struct(sufficiency, probable_cause, suggested_fix, citations, questions, error) of a drafted answer, checked against the retrieved keys.

    An uncited draft needs a sufficiency of 2 or less, and every draft a cause and a fix; quotes are cut
    to 140 characters, questions to three.
    """
    v = F.try_parse_json(json)
    sufficiency = _integer(json, "$.context_sufficiency")
    cites = F.coalesce(F.try_variant_get(v, "$.citations", "array<struct<source:string,quote:string>>"), F.array().cast("array<struct<source:string,quote:string>>"))
    cut = F.transform(cites, lambda c: F.struct(c["source"].alias("source"), F.substring(strip(F.coalesce(c["quote"], F.lit(""))), 1, 140).alias("quote")))
    questions = F.slice(F.coalesce(F.try_variant_get(v, "$.clarifying_questions", "array<string>"), F.array().cast("array<string>")), 1, 3)
    foreign = F.exists(cites, lambda c: c["source"].isNull() | ~F.array_contains(allowed, c["source"]))
    cause, fix = (_truthy(v, f"$.{c}") for c in ("probable_cause", "suggested_fix"))
    error = F.when(v.isNull(), "no object").when(sufficiency.isNull() | ~sufficiency.between(1, 5), "bad sufficiency").when(foreign, "citation outside the context").when((F.size(cites) == 0) & (sufficiency > 2), "uncited").when(cause.isNull() | fix.isNull(), "no cause or fix")
    return F.struct(sufficiency.alias("sufficiency"), cause.alias("probable_cause"), fix.alias("suggested_fix"), cut.alias("citations"), questions.alias("questions"), error.alias("error"))
