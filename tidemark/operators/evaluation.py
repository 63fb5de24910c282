"""Evaluation of retrieval: ranks, staleness, leakage, orphans, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_ranks(results: DataFrame, relevant: Column, own: Column | None = None, top: int = 8) -> DataFrame:
    """(query_id, first_rank) of (query_id, position, ...): the first relevant place among the top, null if none.

    Rows for which ``own`` holds are removed after the cut and the others move up.
    """
    rows = results.where(F.col("position") <= top)
    if own is not None:
        rows = rows.withColumn("own", own)
        rows = rows.withColumn("place", F.sum(F.when(~F.col("own"), 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("position")))
        hit = relevant & ~F.col("own")
    else:
        rows, hit = rows.withColumn("place", F.col("position")), relevant
    return rows.groupBy("query_id").agg(F.min(F.when(hit, F.col("place"))).alias("first_rank"))


def rank_summary(ranks: DataFrame, *by: str) -> DataFrame:
    """n, MRR with misses as 0, hits, and the upper median rank of the hits."""
    hit = F.col("first_rank").isNotNull()
    counts = ranks.groupBy(*by, "first_rank").agg(F.count("*").alias("c"))
    found = F.when(hit, F.col("c")).otherwise(0)
    upto, whole = Window.partitionBy(*by).orderBy("first_rank"), Window.partitionBy(*by)
    rows = counts.withColumns({"upto": F.sum(found).over(upto), "all_hits": F.sum(found).over(whole)})
    return rows.groupBy(*by).agg(
        F.sum("c").alias("n"), (F.sum(F.col("c") * F.coalesce(F.try_divide(F.lit(1.0), "first_rank"), F.lit(0.0))) / F.sum("c")).alias("mrr"), F.max("all_hits").alias("hits"),
        F.min(F.when(hit & (F.col("upto") > F.floor(F.col("all_hits") / 2)), F.col("first_rank"))).alias("median_rank"),
    )


def staleness(before: DataFrame, after: DataFrame, changes: DataFrame, results: DataFrame, n_queries: int | None = None) -> DataFrame:
    """(n_modified, n_stale_pages, n_missing, n_served, n_queries, share): how many queries are served a page whose content has changed since.

    before and after hold (path, content_hash); only modified paths are compared. A page without a hash
    on either side is missing. results holds (query_id, path) of the served lists.
    """
    paths = changes.where("change_type = 'modified'").select("path").distinct()
    both = paths.join(before.withColumnRenamed("content_hash", "h0"), "path", "left").join(after.withColumnRenamed("content_hash", "h1"), "path", "left")
    state = both.withColumn("missing", F.col("h0").isNull() | F.col("h1").isNull()).withColumn("stale", ~F.col("missing") & (F.col("h0") != F.col("h1")))
    served = results.join(state.where("stale").select("path"), "path", "left_semi").agg(F.count_distinct("query_id").alias("n_served"))
    pages = state.agg(F.count("*").alias("n_modified"), F.count_if("stale").alias("n_stale_pages"), F.count_if("missing").alias("n_missing"))
    asked = results.agg(F.count_distinct("query_id").alias("n_queries")) if n_queries is None else results.sparkSession.range(1).select(F.lit(n_queries).cast("bigint").alias("n_queries"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(pages).join(one(served), "one").join(one(asked), "one").drop("one").withColumn("share", F.try_divide("n_served", "n_queries"))


def leakage(results: DataFrame) -> DataFrame:
    """(n_results, n_foreign, foreign_share, n_queries, n_leaking) of (query_id, query_tenant, key_tenant)."""
    per = results.withColumn("foreign", F.col("query_tenant") != F.col("key_tenant")).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("foreign").alias("f"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_results"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_foreign"), F.count("*").alias("n_queries"), F.count_if(F.col("f") > 0).alias("n_leaking")).withColumn("foreign_share", F.try_divide("n_foreign", "n_results"))


def tenant_blind_share(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(expected_share): the mean over queries of the share of the corpus that other tenants own."""
    pool = corpus.groupBy("tenant_id").agg(F.count("*").alias("n"))
    total = pool.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1))
    per = queries.join(pool, "tenant_id", "left").withColumn("one", F.lit(1)).join(total, "one")
    return per.agg(F.avg(1 - F.coalesce("n", F.lit(0)) / F.col("total")).alias("expected_share"))


def orphans(before: DataFrame, after: DataFrame, target: Column) -> DataFrame:
    """(query_id, served_before, served_after): whether each query's list holds the target on either snapshot."""
    side = lambda df, name: df.groupBy("query_id").agg(F.max(target).alias(name))
    rows = side(before, "served_before").join(side(after, "served_after"), "query_id", "full")
    return rows.select("query_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("served_before", "served_after")))


def tenant_counts(rows: DataFrame, tenants: int) -> DataFrame:
    """(n_tenants, least, most, mean): rows of each tenant, those without rows counted as 0."""
    counts = rows.groupBy("tenant_id").agg(F.count("*").alias("n"))
    all_of = rows.sparkSession.range(tenants).select(F.col("id").cast("int").alias("tenant_id"))
    return all_of.join(counts, "tenant_id", "left").agg(F.count("*").alias("n_tenants"), F.coalesce(F.min(F.coalesce("n", F.lit(0))), F.lit(0)).alias("least"), F.max(F.coalesce("n", F.lit(0))).alias("most"), F.avg(F.coalesce("n", F.lit(0))).alias("mean"))


def cost(log: DataFrame, *by: str, input_rate: float = 1e-6, output_rate: float = 5e-6) -> DataFrame:
    """calls, tokens and cost at fixed rates, rounded to 4."""
    total = F.sum("input_tokens") * input_rate + F.sum("output_tokens") * output_rate
    return log.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(total, 4).alias("cost"))


def health_gate(rows: DataFrame, degraded: Column, most: int) -> int:
    """The number of degraded rows; more than ``most`` abort the run."""
    n = rows.agg(F.count_if(degraded)).first()[0]
    if n > most:
        raise RuntimeError(f"{n} degraded rows, {most} are allowed")
    return n


def accuracy(rows: DataFrame, correct: Column, *by: str) -> DataFrame:
    """(n, n_correct, accuracy) of each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(correct).alias("n_correct")).withColumn("accuracy", F.try_divide("n_correct", "n"))
