"""Queries on evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import hashing, stats
from tidemark.operators import evaluation, vector
from tidemark.plans import tables as T
from tidemark.plans.registry import register
from tidemark.plans.retrieval import SQL_LISTS, _sim


def _results(spark: SparkSession, sf_dir: str, same_tenant: bool) -> DataFrame:
    """(query_id, position, key, labels and tenants of both sides) of the exact vector list."""
    corpus = T.vectors(spark, sf_dir)
    asked = T.vector_queries(corpus)
    found = vector.exact_top(asked, corpus, same_tenant=same_tenant).select("query_id", "key", F.col("rank").alias("position"))
    rows = found.join(corpus.select("key", "label", F.col("tenant_id").alias("key_tenant")), "key")
    return rows.join(asked.select("query_id", "query_label", F.col("tenant_id").alias("query_tenant")), "query_id")


def _ranks(spark: SparkSession, sf_dir: str, same_tenant: bool) -> DataFrame:
    return evaluation.first_ranks(_results(spark, sf_dir, same_tenant), F.col("label") == F.col("query_label"), F.col("key") == F.col("query_id"))


def _sql_ranks(of: str) -> str:
    return f"""(WITH r AS (SELECT l.query_id, l.rank, l.key = l.query_id AS own, v.label = q.query_label AS rel FROM {of} l JOIN v ON v.key = l.key JOIN q ON q.query_id = l.query_id WHERE rank <= 8),
    n AS (SELECT *, sum((NOT own)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS place FROM r) SELECT query_id, min(CASE WHEN rel AND NOT own THEN place END) AS first_rank FROM n GROUP BY query_id)"""


_SUMMARY = "count(*) AS n, round(avg(coalesce(1.0 / first_rank, 0)), 9) AS mrr, count(first_rank) AS hits, list_sort(list(first_rank) FILTER (first_rank IS NOT NULL))[(count(first_rank) // 2 + 1)::INT]::BIGINT AS median_rank"


@register("mrr_by_arm", f"WITH {SQL_LISTS} SELECT 'all' AS arm, {_SUMMARY} FROM {_sql_ranks('la')} UNION ALL SELECT 'tenant', {_SUMMARY} FROM {_sql_ranks('lt')}")
def mrr_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = [_ranks(spark, sf_dir, same).withColumn("arm", F.lit(name)) for name, same in (("all", False), ("tenant", True))]
    return evaluation.rank_summary(arms[0].unionByName(arms[1]), "arm").withColumns({"mrr": F.round("mrr", 9), "median_rank": F.col("median_rank").cast("bigint")})


@register("mcnemar", f"""WITH RECURSIVE {SQL_LISTS}, h AS (SELECT a.query_id, a.first_rank = 1 AS b, t.first_rank IS NOT NULL AS x FROM {_sql_ranks('la')} a JOIN {_sql_ranks('lt')} t USING (query_id)),
k AS (SELECT count(*) AS n_pairs, count_if(coalesce(b, false) AND NOT x) AS base_only, count_if(NOT coalesce(b, false) AND x) AS arm_only FROM h),
s AS (SELECT 0 AS i, pow(0.5, base_only + arm_only) AS p, pow(0.5, base_only + arm_only) AS total, base_only + arm_only AS n, least(base_only, arm_only) AS m FROM k UNION ALL SELECT i + 1, p * (n - i) / (i + 1), total + p * (n - i) / (i + 1), n, m FROM s WHERE i < m)
SELECT n_pairs, base_only, arm_only, round(CASE WHEN base_only + arm_only = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT max(total) FROM s)) END, 9) AS p_value FROM k""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit at the first place without the tenant filter, against any hit with it."""
    base = _ranks(spark, sf_dir, False).select("query_id", F.coalesce(F.col("first_rank") == 1, F.lit(False)).alias("hit"))
    arm = _ranks(spark, sf_dir, True).select("query_id", F.col("first_rank").isNotNull().alias("hit"))
    return stats.mcnemar(base, arm, "query_id", "hit").withColumn("p_value", F.round("p_value", 9))


@register("leakage", f"WITH {SQL_LISTS}, r AS (SELECT l.query_id, v.tenant_id <> q.tenant_id AS f FROM la l JOIN v ON v.key = l.key JOIN q ON q.query_id = l.query_id WHERE rank <= 8), p AS (SELECT query_id, count(*) AS n, count_if(f) AS f FROM r GROUP BY query_id) SELECT sum(n)::BIGINT AS n_results, sum(f)::BIGINT AS n_foreign, count(*) AS n_queries, count_if(f > 0) AS n_leaking, round(sum(f) / sum(n), 9) AS foreign_share FROM p")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.leakage(_results(spark, sf_dir, False).where("position <= 8")).withColumn("foreign_share", F.round("foreign_share", 9))


@register("leakage_filtered", f"WITH {T.SQL_VECTORS}, l AS ({_sim('q.tenant_id = v.tenant_id')}), p AS (SELECT query_id, count(*) AS n FROM l WHERE rank <= 8 GROUP BY query_id) SELECT sum(n)::BIGINT AS n_results, 0 AS n_foreign, count(*) AS n_queries FROM p")
def leakage_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the filter on, no foreign row is ever served."""
    return evaluation.leakage(_results(spark, sf_dir, True).where("position <= 8")).select("n_results", F.col("n_foreign").cast("int").alias("n_foreign"), "n_queries")


@register("tenant_blind_share", f"WITH {T.SQL_VECTORS}, p AS (SELECT tenant_id, count(*) AS n FROM v GROUP BY 1) SELECT round(avg(1 - coalesce(p.n, 0) / (SELECT count(*) FROM v)), 9) AS expected_share FROM q LEFT JOIN p USING (tenant_id)")
def tenant_blind_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = T.vectors(spark, sf_dir)
    return evaluation.tenant_blind_share(corpus, T.vector_queries(corpus)).withColumn("expected_share", F.round("expected_share", 9))


@register("kappa", """WITH r AS (SELECT quality AS a, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS b FROM labels JOIN documents USING (doc_id)), c AS (SELECT a, b, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c),
x AS (SELECT sum(na * nb) AS chance FROM (SELECT a AS k, sum(n) AS na FROM c GROUP BY a) JOIN (SELECT b AS k, sum(n) AS nb FROM c GROUP BY b) USING (k))
SELECT n::BIGINT AS n, round(same / n, 9) AS observed, round(chance / (n * n), 9) AS expected, round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 9) AS kappa FROM t, x""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled quality against a rule on length."""
    rows = T.table(spark, sf_dir, "labels").join(T.table(spark, sf_dir, "documents"), "doc_id").select(F.col("quality").alias("a"), F.when(F.col("n_chars") >= 300, 1).otherwise(0).alias("b"))
    return stats.kappa(rows, "a", "b").select("n", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


@register("bootstrap")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 95 percent interval of the mean quality label."""
    return stats.bootstrap(T.table(spark, sf_dir, "labels"), "quality")


_STALE = f"""{T.SQL_CHANGES}, a AS (SELECT path, arg_max(payload, (seq, op_no)) AS payload, arg_max(live, (seq, op_no)) AS live FROM o WHERE seq <= 500 GROUP BY path), z AS (SELECT path, arg_max(payload, (seq, op_no)) AS payload, arg_max(live, (seq, op_no)) AS live FROM o GROUP BY path)"""


@register("staleness", f"""WITH {_STALE}, m AS (SELECT DISTINCT path FROM c WHERE change_type = 'modified' AND seq > 500), s AS (SELECT m.path, a.payload AS h0, z.payload AS h1 FROM m LEFT JOIN (SELECT * FROM a WHERE live) a USING (path) LEFT JOIN (SELECT * FROM z WHERE live) z USING (path)),
r AS (SELECT DISTINCT event_id // 10 AS query_id, user_id::VARCHAR AS path FROM events)
SELECT count(*) AS n_modified, count_if(h0 IS NOT NULL AND h1 IS NOT NULL AND h0 <> h1) AS n_stale_pages, count_if(h0 IS NULL OR h1 IS NULL) AS n_missing, (SELECT count(DISTINCT query_id) FROM r WHERE path IN (SELECT path FROM s WHERE h0 <> h1)) AS n_served, (SELECT count(DISTINCT query_id) FROM r) AS n_queries,
  (SELECT count(DISTINCT query_id) FROM r WHERE path IN (SELECT path FROM s WHERE h0 <> h1)) / (SELECT count(DISTINCT query_id) FROM r) AS share FROM s""")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after change 500 against the corpus after all; each ten events stand in for a served list."""
    from tidemark.operators import replay

    changes = T.changes(spark, sf_dir)
    content = lambda df: df.select("path", F.md5("payload").alias("content_hash"))
    served = T.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("query_id"), F.col("user_id").cast("string").alias("path")).distinct()
    return evaluation.staleness(content(replay.view(changes, as_of=500)), content(replay.view(changes)), changes.where("seq > 500"), served)


@register("orphans", f"WITH {T.SQL_VECTORS}, a AS ({_sim('true')}), b AS ({_sim('v.key <> 40')}) SELECT q.query_id, coalesce((SELECT bool_or(key = 40) FROM a WHERE a.query_id = q.query_id AND rank <= 8), false) AS served_before, coalesce((SELECT bool_or(key = 40) FROM b WHERE b.query_id = q.query_id AND rank <= 8), false) AS served_after FROM q")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector 40 is deleted: who was served it before, and after."""
    corpus = T.vectors(spark, sf_dir)
    asked = T.vector_queries(corpus)
    lists = [vector.exact_top(asked, c, k=8) for c in (corpus, corpus.where("key <> 40"))]
    return evaluation.orphans(*lists, F.col("key") == 40)


@register("held_out_barrier", f"SELECT count(*) AS n_rows, count_if(('0x' || substr(sha256('heldout:' || vec_id), 1, 16))::UBIGINT % 10 <> 0 AND embedding IS NOT NULL) AS n_searchable FROM embeddings")
def held_out_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.tickets import searchable

    rows = T.table(spark, sf_dir, "embeddings").withColumn("is_held_out", hashing.is_held_out(F.col("vec_id")))
    kept = searchable(rows).agg(F.count("*").alias("n_searchable")).withColumn("one", F.lit(1))
    return rows.agg(F.count("*").alias("n_rows")).withColumn("one", F.lit(1)).join(kept, "one").drop("one")
