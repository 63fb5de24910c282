"""Ticket records: shaping, derived columns, joins with side tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import hashing, text as T


def closing_request(nodes: Column, upstream: str) -> Column:
    """The first merged closing request of the upstream repository, else the first of it, else null."""
    ours = F.filter(nodes, lambda n: n["repository"]["nameWithOwner"] == upstream)
    return F.coalesce(F.try_element_at(F.filter(ours, lambda n: n["merged"]), F.lit(1)), F.try_element_at(ours, F.lit(1)))


def shape(raw: DataFrame, groups: Sequence[str], upstream: str) -> DataFrame:
    """Issue records as tickets: label names, the allowed group labels sorted, no null bodies, one closing request."""
    names = F.coalesce(F.transform("labels", lambda x: x["name"]), F.array().cast("array<string>"))
    best = closing_request(F.col("closing_nodes"), upstream)
    return raw.select(
        "number", "title", F.coalesce("body", F.lit("")).alias("body"), names.alias("labels"), F.array_sort(F.filter(names, lambda n: n.isin(*groups))).alias("sigs"),
        F.to_timestamp("created_at").alias("created_at"), F.to_timestamp("closed_at").alias("closed_at"), "url", best["number"].alias("closing_pr_number"), best["url"].alias("closing_pr_url"),
    )


def derive(tickets: DataFrame) -> DataFrame:
    """Adds tenant_id, is_held_out, has_images and embed_text in one pass."""
    n = F.col("number")
    return tickets.withColumns({"tenant_id": hashing.tenant_of(n), "is_held_out": hashing.is_held_out(n), "has_images": T.has_images(F.col("body")), "embed_text": T.embed_text(F.col("title"), F.col("body"))})


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key: the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def attach_vectors(tickets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Embeddings of the rows that are not held out; the others stay null."""
    return tickets.join(vectors.select("number", F.col("embedding").alias("_e")), "number", "left").withColumn("embedding", F.when(~F.col("is_held_out"), F.col("_e"))).drop("_e")


def searchable(tickets: DataFrame) -> DataFrame:
    """Rows that may be retrieved: not held out, and with an embedding. Both barriers are pushed to the scan."""
    return tickets.where(F.col("embedding").isNotNull() & ~F.col("is_held_out"))


def hydrate(tickets: DataFrame, cache: DataFrame) -> DataFrame:
    """closing_pr_title and closing_pr_body from a cache (number, title, body); entries without a title are skipped."""
    have = {c: F.col(c) if c in tickets.columns else F.lit(None).cast("string") for c in ("closing_pr_title", "closing_pr_body")}
    new = cache.where("title IS NOT NULL").select(F.col("number").alias("closing_pr_number"), F.col("title").alias("_t"), F.col("body").alias("_b"))
    rows = tickets.withColumns(have).join(new, "closing_pr_number", "left")
    return rows.withColumns({"closing_pr_title": F.coalesce("_t", "closing_pr_title"), "closing_pr_body": F.coalesce("_b", "closing_pr_body")}).drop("_t", "_b")


def not_cached(tickets: DataFrame, cache: DataFrame) -> DataFrame:
    """Numbers of closing requests that the cache lacks."""
    return tickets.where("closing_pr_number IS NOT NULL").select(F.col("closing_pr_number").alias("number")).distinct().join(cache.select("number"), "number", "left_anti")


def captions(tickets: DataFrame, cache: DataFrame) -> DataFrame:
    """(number, captions): captions of each ticket's images, in their order, those not cached left out. cache holds (url, caption)."""
    urls = tickets.select("number", F.posexplode(T.image_urls(F.col("body"))).alias("i", "url"))
    found = urls.join(cache.where("caption IS NOT NULL"), "url").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("i", "caption"))).alias("l"))
    return found.select("number", F.array_join(F.transform("l", lambda x: x["caption"]), " ").alias("captions"))


def recaption(tickets: DataFrame, found: DataFrame) -> DataFrame:
    """A new corpus version: rows that are not held out and have captions get the captioned text, and a flag; their old vector goes."""
    rows = tickets.join(found, "number", "left").withColumn("caption_applied", ~F.col("is_held_out") & (F.coalesce("captions", F.lit("")) != ""))
    rows = rows.withColumn("embed_text", F.when(F.col("caption_applied"), T.captioned_embed_text(F.col("title"), F.col("body"), F.col("captions"))).otherwise(F.col("embed_text")))
    return (rows.withColumn("embedding", F.when(~F.col("caption_applied"), F.col("embedding"))) if "embedding" in tickets.columns else rows).drop("captions")


def fill_sheet(sheet: DataFrame, outcomes: DataFrame, scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """Run outcomes and scores written into the sheet by ticket; score columns stay empty where the run was degraded."""
    new = outcomes.select("ticket_number", *(F.col(c).alias(f"_{c}") for c in ("degraded", "route")))
    rows = sheet.join(new, "ticket_number", "left").join(scores.select("ticket_number", *(F.col(c).alias(f"_{c}") for c in names)), "ticket_number", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(f"_{c}").cast("string"), F.col(c)) for c in ("degraded", "route")})
    return rows.withColumns({c: F.when(~F.coalesce("_degraded", F.lit(False)), F.coalesce(F.col(f"_{c}"), F.col(c))) for c in names}).drop(*(f"_{c}" for c in ("degraded", "route", *names)))


def directory_match(rows: DataFrame, directories: DataFrame, *key: str) -> DataFrame:
    """Adds in_domain to rows (key, sigs, url): whether the address holds a directory of one of the row's groups. directories holds (sig, dirs)."""
    hits = rows.select(*key, "url", F.explode("sigs").alias("sig")).join(directories, "sig").groupBy(*key).agg(F.max(F.exists("dirs", lambda d: F.contains("url", d))).alias("in_domain"))
    return rows.join(hits, list(key), "left").withColumn("in_domain", F.coalesce("in_domain", F.lit(False)))


def newest(rows: DataFrame, n: int, order: str = "number") -> DataFrame:
    """The n newest rows that are held out; n is the size of an evaluation set."""
    return rows.where("is_held_out").orderBy(F.desc(order)).limit(n)


def split_valid(rows: DataFrame, tenants: int = hashing.TENANTS) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) incoming tickets: a tenant in range and a title that is not blank."""
    ok = F.coalesce(F.col("tenant_id").between(0, tenants - 1) & (T.strip(F.col("title")) != ""), F.lit(False))
    return rows.where(ok), rows.where(~ok)
