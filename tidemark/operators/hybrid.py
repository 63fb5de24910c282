"""Hybrid search: four ranked lists over two corpora, fused."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import fulltext, fusion, vector
from tidemark.operators.posindex import KeptIndex
from tidemark.operators.tickets import searchable

log = logging.getLogger(__name__)


def ticket_index(index: KeptIndex, tickets: DataFrame, generation: int = 0) -> KeptIndex:
    """``index`` with the searchable tickets (key, vec, text, tenant_id, is_held_out) added, each under its tenant."""
    return index.append(searchable(tickets.withColumn("embedding", F.col("vec"))), generation, "tenant_id")


def hybrid_search(queries: DataFrame, docs: DataFrame, tickets: DataFrame, tenant_filter: bool = True, mode: str = "any", k: int = fulltext.K, top: int = fusion.TOP, indexes: Mapping[str, KeptIndex] | None = None) -> DataFrame:
    """(query_id, key, corpus, score, ranks, position, text) of the best keys of each query of the batch.

    queries holds query_id, qvec, terms, tenant_id; docs key, vec, text; tickets those with tenant_id and
    is_held_out. Tickets are searched inside the query's tenant unless the filter is switched off, which
    is logged. Held-out tickets and tickets without a vector are in no list; docs without one are in no
    vector list. Lists and fusion carry keys only; texts are joined to the final rows.

    indexes: kept full-text indexes of the "docs" and of the searchable "tickets" (``ticket_index``); then no
    text is scanned for the lists, and terms are compared by stem if the indexes are.
    """
    if not tenant_filter:
        log.warning("the tenant filter is off: tickets of all tenants are served")
    held = searchable(tickets.withColumn("embedding", F.col("vec")))
    asked = queries.select("query_id", "qvec", "tenant_id")
    terms = queries.select("query_id", "terms", "tenant_id")
    texts = {name: indexes[name].search if indexes else lambda *a, rows=rows, **b: fulltext.match(a[0], rows, *a[1:], **b) for name, rows in (("docs", docs), ("tickets", held))}
    lists = {
        "docs_vector": vector.exact_top(asked, docs, k),
        "docs_fts": texts["docs"](terms, k, mode),
        "tickets_vector": vector.exact_top(asked, held, k, same_tenant=tenant_filter),
        "tickets_fts": texts["tickets"](terms, k, mode, same_tenant=tenant_filter),
    }
    prefix = lambda name: F.concat(F.lit(name.split("_")[0] + ":"), F.col("key").cast("string")).alias("key")
    fused = fusion.fuse({name: df.select("query_id", prefix(name), "rank") for name, df in lists.items()}, top=top)
    payload = docs.select(prefix("docs"), F.lit("docs").alias("corpus"), "text").unionByName(held.select(prefix("tickets"), F.lit("tickets").alias("corpus"), "text"))
    return fused.join(payload, "key").select("query_id", "key", "corpus", "score", "ranks", "position", "text")
