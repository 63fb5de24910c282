"""Queries on ranked retrieval: vectors, full text, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import hashing
from tidemark.operators import fulltext, fusion, hybrid, posindex, quantised, vector
from tidemark.plans import tables as T
from tidemark.plans.registry import register
from tidemark.sources.shared import materialise, table_path


def _sim(condition: str, k: int = 20) -> str:
    return f"""SELECT query_id, key, round(s, 6) + 0.0 AS similarity, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, key))::INT AS rank
    FROM (SELECT q.query_id, v.key, list_cosine_similarity(q.qvec, v.vec) AS s FROM q JOIN v ON {condition})) WHERE rank <= {k}"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "key", (F.round("similarity", 6) + 0.0).alias("similarity"), "rank")


@register("vector_topk", f"WITH {T.SQL_VECTORS} {_sim('true')}")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = T.vectors(spark, sf_dir)
    return _rounded(vector.exact_top(T.vector_queries(corpus), corpus))


@register("vector_topk_tenant", f"WITH {T.SQL_VECTORS} {_sim('q.tenant_id = v.tenant_id')}")
def vector_topk_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = T.vectors(spark, sf_dir)
    return _rounded(vector.exact_top(T.vector_queries(corpus), corpus, same_tenant=True))


def _fused(lists: str) -> str:
    return f"""f AS (SELECT query_id, key, sum(1.0 / (60 + rank)) AS score, count(*) AS n_lists FROM ({lists}) GROUP BY query_id, key),
    p AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, key))::INT AS position FROM f)"""


SQL_LISTS = f"{T.SQL_VECTORS}, la AS ({_sim('true')}), lt AS ({_sim('q.tenant_id = v.tenant_id')})"
SQL_FUSED = f"{SQL_LISTS}, {_fused('SELECT * FROM la UNION ALL SELECT * FROM lt')}"


def fused_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = T.vectors(spark, sf_dir)
    return fusion.fuse_rows(vector.exact_lists(T.vector_queries(corpus), corpus, {"all_vector": False, "tenant_vector": True}))


@register("rrf_fusion", f"WITH {SQL_FUSED} SELECT query_id, key, round(score, 9) AS score, position, n_lists::INT AS n_lists FROM p WHERE position <= 8")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_vectors(spark, sf_dir).select("query_id", "key", F.round("score", 9).alias("score"), "position", F.size("ranks").alias("n_lists"))


@register("list_facts", f"WITH {SQL_FUSED} SELECT query_id, count_if(n_lists >= 2) AS n_agree, count_if(EXISTS (SELECT 1 FROM la WHERE la.query_id = p.query_id AND la.key = p.key)) AS n_all_vector, count_if(EXISTS (SELECT 1 FROM lt WHERE lt.query_id = p.query_id AND lt.key = p.key)) AS n_tenant_vector FROM p WHERE position <= 8 GROUP BY query_id")
def list_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.list_facts(fused_vectors(spark, sf_dir), ["all_vector", "tenant_vector"])


@register("vector_cells")
def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate search by cells, with its recall against the exact result in every row."""
    corpus = T.vectors(spark, sf_dir)
    asked = T.vector_queries(corpus)
    index = vector.CellIndex(corpus)
    cells, exact = materialise(index.assign(corpus), "cells"), materialise(vector.exact_top(asked, corpus), "exact")
    found = materialise(index.top(asked, cells, probes=index.calibrate(asked, cells, exact)), "found")
    share = vector.recall(found, exact)
    return found.withColumn("one", F.lit(1)).join(share.select(F.lit(1).alias("one"), "recall"), "one").drop("one")


@register("vector_index")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by a kept index of quantised residuals, opened again after it was written, with its recall and the bytes of its codes a vector byte in every row."""
    corpus = T.vectors(spark, sf_dir)
    asked = T.vector_queries(corpus)
    folder = table_path(spark, "vector-index")
    quantised.KeptVectors.create(corpus, folder)
    index, exact = quantised.KeptVectors.open(spark, folder), materialise(vector.exact_top(asked, corpus), "exact")
    found = materialise(index.search(asked, probes=index.probes(asked, exact)), "found")
    share = vector.recall(found, exact).select(F.lit(1).alias("one"), "recall")
    size = index.report().select(F.lit(1).alias("one"), (F.col("code_bytes") / F.col("vector_bytes")).alias("code_share"))
    return found.withColumn("one", F.lit(1)).join(share, "one").join(size, "one").drop("one")


@register("dimension_guard", "SELECT vec_id AS key, len(embedding)::INT AS n FROM embeddings WHERE len(embedding) <> 64 OR embedding IS NULL")
def dimension_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.wrong_dimension(T.vectors(spark, sf_dir), "vec", 64).select("key", F.size("vec").alias("n"))


# The oracle covers titles and payload tokens of the data: ASCII-only patterns agree on it.
SQL_TERMS = rf"""b AS (SELECT item_id AS query_id, {T.SQL_TENANT.format('item_id')} AS tenant_id, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1, 2000) ELSE '' END AS body FROM benchmark),
raw AS (SELECT query_id, tenant_id, list_concat(list_filter(regexp_extract_all(lower(title), '[a-z][a-z0-9_-]{{2,}}'), lambda w: NOT list_contains({T.SQL_STOPS}, w)),
  regexp_extract_all(body, '`[^`\n]{{2,60}}`|--[A-Za-z][A-Za-z0-9-]{{2,40}}|\b[a-z][a-z0-9]*(?:[A-Z][a-z0-9]+)+\b|\b[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+){{1,5}}\b|"[^"\n]{{4,60}}"')) AS w FROM b),
pieces AS (SELECT query_id, tenant_id, list_filter(flatten(list_transform(w, lambda x: regexp_split_to_array(lower(x), '[^a-z0-9_]+'))), lambda p: length(p) >= 3 AND NOT list_contains({T.SQL_STOPS}, p)) AS p FROM raw),
firsts AS (SELECT query_id, tenant_id, token, min(i) AS i FROM (SELECT query_id, tenant_id, unnest(p) AS token, generate_subscripts(p, 1) AS i FROM pieces) GROUP BY ALL),
terms AS (SELECT query_id, tenant_id, token, i FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 15)"""
SQL_POSTINGS = rf"""d AS (SELECT doc_id AS key, {T.SQL_TENANT.format('doc_id')} AS tenant_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS token FROM documents),
idx AS (SELECT key, tenant_id, token, count(*) AS tf FROM d WHERE NOT list_contains({T.SQL_STOPS}, token) GROUP BY ALL)"""


def _text_search(on: str = "", having: str = "true") -> str:
    return f"""WITH {SQL_TERMS}, {SQL_POSTINGS}, n AS (SELECT query_id, count(*) AS n FROM terms GROUP BY query_id),
    m AS (SELECT t.query_id, idx.key, sum(tf)::BIGINT AS hits, count(*) AS k FROM terms t JOIN idx ON t.token = idx.token {on} GROUP BY ALL)
    SELECT query_id, key, hits, (row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, key))::INT AS rank FROM m JOIN n USING (query_id) WHERE {having} QUALIFY rank <= 20"""


@register("fts_terms", f"WITH {SQL_TERMS} SELECT query_id, string_agg(token, ' ' ORDER BY i) AS terms FROM terms GROUP BY query_id")
def fts_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.text_queries(spark, sf_dir).where(F.size("terms") > 0).select("query_id", F.array_join("terms", " ").alias("terms"))


@register("fts_any", _text_search())
def fts_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = T.text_queries(spark, sf_dir)
    return fulltext.match(asked, T.texts(spark, sf_dir))


@register("fts_any_tenant", _text_search("AND t.tenant_id = idx.tenant_id"))
def fts_any_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = T.text_queries(spark, sf_dir)
    return fulltext.match(asked, T.texts(spark, sf_dir), same_tenant=True)


@register("fts_all", _text_search(having="k = n"))
def fts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = T.text_queries(spark, sf_dir)
    return fulltext.match(asked, T.texts(spark, sf_dir), mode="all")


def text_index(spark: SparkSession, sf_dir: str, stem: bool = False) -> posindex.KeptIndex:
    """An index of all documents with their tenants, kept in two generations: every third document is added later."""
    index, docs = posindex.KeptIndex(spark, table_path(spark, "text-index"), stem), T.texts(spark, sf_dir)
    return index.append(docs.where("key % 3 <> 0"), 0, "tenant_id").append(docs.where("key % 3 = 0"), 1, "tenant_id")


@register("fts_index_any", _text_search())
def fts_index_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fts_any`` by a kept index: only zones whose bound reaches the k best are read."""
    return text_index(spark, sf_dir).search(T.text_queries(spark, sf_dir))


@register("fts_index_all_tenant", _text_search("AND t.tenant_id = idx.tenant_id", having="k = n").replace("<= 15)", "<= 2)"))
def fts_index_all_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of two terms, both in a document of the query's tenant."""
    asked = T.text_queries(spark, sf_dir).withColumn("terms", F.slice("terms", 1, 2))
    return text_index(spark, sf_dir).search(asked, mode="all", same_tenant=True)


#: Typed queries of benchmark items by the places of their tokens: a word, a phrase, a negated word, or two words, or a phrase and a word.
_TYPED = ((0, 0, False, (1,)), (0, 1, False, (2, 3, 4)), (0, 2, True, (12,)), (1, 3, False, (6,)), (1, 4, False, (7,)), (2, 5, False, (20, 21)), (2, 6, False, (8,)))


def typed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): queries as a user types them, of the words of each benchmark item."""
    token = lambda i: F.coalesce(F.get(fulltext.tokens(F.col("text")), i - 1), F.lit("zz"))
    said, before = [], 0
    for alternative, _, negated, places in _TYPED:
        words = F.concat_ws(" ", *map(token, places))
        part = F.concat(F.lit('"'), words, F.lit('"')) if len(places) > 1 else words
        said += [F.lit("OR")] * (alternative - before) + [F.concat(F.lit("-"), part) if negated else part]
        before = alternative
    return T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", *said).alias("text"))


SQL_TYPED = rf"""bt AS (SELECT item_id AS query_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS l FROM benchmark),
u0 AS ({' UNION ALL '.join(f"SELECT query_id, {a} AS alt, {n} AS unit, {neg} AS negated, {k} AS place, coalesce(l[{i}], 'zz') AS token FROM bt" for a, n, neg, places in _TYPED for k, i in enumerate(places))}),
u AS (SELECT * FROM u0 WHERE NOT list_contains({T.SQL_STOPS}, token)), un AS (SELECT query_id, alt, unit, negated, count(*) AS words, min(place) AS lo, max(place) AS hi FROM u GROUP BY ALL),
d AS (SELECT doc_id AS key, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS l FROM documents), ps AS (SELECT key, unnest(l) AS token, generate_subscripts(l, 1) AS p FROM d),
oc AS (SELECT query_id, alt, unit, negated, key, s + lo AS a, s + hi AS z FROM (SELECT u.query_id, u.alt, u.unit, ps.key, ps.p - u.place AS s, count(*) AS c FROM u JOIN ps USING (token) GROUP BY ALL) JOIN un USING (query_id, alt, unit) WHERE c = words),
nc AS (SELECT query_id, alt, count_if(NOT negated) AS units FROM un GROUP BY ALL),
ok AS (SELECT query_id, alt, key FROM (SELECT query_id, alt, key, count(DISTINCT CASE WHEN NOT negated THEN unit END) AS c, bool_or(negated) AS bad FROM oc GROUP BY ALL) JOIN nc USING (query_id, alt) WHERE c = units AND NOT bad),
po AS (SELECT oc.* FROM oc JOIN ok USING (query_id, alt, key)), en AS (SELECT DISTINCT query_id, alt, key, z FROM po),
la AS (SELECT en.query_id, en.alt, en.key, en.z, po.unit, max(po.a) AS a FROM en JOIN po ON po.query_id = en.query_id AND po.alt = en.alt AND po.key = en.key AND po.z <= en.z GROUP BY ALL),
sp AS (SELECT query_id, key, a, min(z) AS z FROM (SELECT query_id, alt, key, z, min(a) AS a, count(*) AS c FROM la GROUP BY ALL) JOIN nc USING (query_id, alt) WHERE c = units GROUP BY query_id, key, a),
mi AS (SELECT DISTINCT * FROM sp WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE o.query_id = sp.query_id AND o.key = sp.key AND o.a >= sp.a AND o.z <= sp.z AND (o.a > sp.a OR o.z < sp.z))),
ak AS (SELECT DISTINCT query_id, key, p FROM u JOIN ps USING (token) WHERE NOT negated),
ns AS (SELECT mi.query_id, mi.key, mi.a, mi.z, (mi.z - mi.a + 1) - count(*) AS noise FROM mi JOIN ak ON ak.query_id = mi.query_id AND ak.key = mi.key AND ak.p BETWEEN mi.a AND mi.z GROUP BY mi.query_id, mi.key, mi.a, mi.z),
sc AS (SELECT query_id, key, round(sum(1.0 / (1 + noise)), 9) AS score FROM ns GROUP BY ALL)"""


@register("fts_cover", f"WITH {SQL_TYPED} SELECT query_id, key, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key))::INT AS rank FROM sc QUALIFY rank <= 20")
def fts_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed queries with phrases, negation and alternatives, ranked by cover density over the kept index."""
    return text_index(spark, sf_dir).cover(typed_queries(spark, sf_dir))


def _sql_stem(word: str) -> str:
    """``fulltext.stem`` as a CASE: the first ending that leaves three letters and a vowel goes."""
    arms = []
    for e in fulltext._ENDINGS:
        base = f"substr({word}, 1, length({word}) - {len(e)})"
        stem = f"{base} || 'y'" if e == "ies" else base
        if e in ("ing", "ed"):
            last = f"substr({base}, length({base}), 1)"
            stem = f"CASE WHEN length({base}) > 3 AND {last} = substr({base}, length({base}) - 1, 1) AND {last} NOT IN ('l', 's', 'z') THEN substr({base}, 1, length({base}) - 1) ELSE {base} END"
        arms.append(f"WHEN ends_with({word}, '{e}') AND length({word}) >= {len(e) + 3} AND regexp_matches({base}, '[aeiouy]') THEN {stem}")
    return f"CASE {' '.join(arms)} ELSE {word} END"


@register("fts_stemmed", f"""WITH {SQL_TERMS}, {SQL_POSTINGS}, st AS (SELECT DISTINCT query_id, {_sql_stem('token')} AS token FROM terms), si AS (SELECT key, {_sql_stem('token')} AS token, sum(tf) AS tf FROM idx GROUP BY ALL),
m AS (SELECT st.query_id, si.key, sum(tf)::BIGINT AS hits FROM st JOIN si ON st.token = si.token GROUP BY ALL) SELECT query_id, key, hits, (row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, key))::INT AS rank FROM m QUALIFY rank <= 20""")
def fts_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any-term search by stems on both sides."""
    return fulltext.match(fulltext.stemmed_terms(T.text_queries(spark, sf_dir)), T.texts(spark, sf_dir), stemmed_words=True)


def hybrid_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, rows of four lists): every document with a vector whose id is divisible by QUERY_MOD asks with both; lists over all and over its tenant's."""
    corpus = T.vectors(spark, sf_dir)
    asked = T.vector_queries(corpus)
    docs = T.texts(spark, sf_dir)
    words = docs.where(F.col("key") % T.QUERY_MOD == 0).join(asked.select(F.col("query_id").alias("key")), "key", "left_semi")
    terms = words.select(F.col("key").alias("query_id"), fulltext.query_terms(F.col("text")).alias("terms"), "tenant_id")
    found = vector.exact_lists(asked, corpus, {"all_vector": False, "tenant_vector": True}), fulltext.match_lists(terms, docs, {"all_fts": False, "tenant_fts": True})
    return asked, found[0].select("list", "query_id", "key", "rank").union(found[1].select("list", "query_id", "key", "rank"))


SQL_HYBRID = rf"""{SQL_LISTS}, b AS (SELECT doc_id AS query_id, {T.SQL_TENANT.format('doc_id')} AS tenant_id, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1, 2000) ELSE '' END AS body FROM documents WHERE doc_id % {T.QUERY_MOD} = 0 AND doc_id IN (SELECT query_id FROM q)), {SQL_TERMS.split('FROM benchmark),', 1)[1]}, {SQL_POSTINGS},
ma AS (SELECT t.query_id, idx.key, sum(tf) AS hits FROM terms t JOIN idx ON t.token = idx.token GROUP BY ALL), mt AS (SELECT t.query_id, idx.key, sum(tf) AS hits FROM terms t JOIN idx ON t.token = idx.token AND t.tenant_id = idx.tenant_id GROUP BY ALL),
fa AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, key) AS rank FROM ma QUALIFY rank <= 20), ft AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, key) AS rank FROM mt QUALIFY rank <= 20),
{_fused("SELECT query_id, key, rank FROM la UNION ALL SELECT query_id, key, rank FROM lt UNION ALL SELECT * FROM fa UNION ALL SELECT * FROM ft")}"""


@register("hybrid_search", f"WITH {SQL_HYBRID} SELECT query_id, key, round(score, 9) AS score, position, n_lists::INT AS n_lists FROM p WHERE position <= 8")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lists = hybrid_lists(spark, sf_dir)
    return fusion.fuse_rows(lists).select("query_id", "key", F.round("score", 9).alias("score"), "position", F.size("ranks").alias("n_lists"))


@register("retrieval_confidence", f"""WITH {SQL_HYBRID}, r AS (SELECT p.*, (EXISTS (SELECT 1 FROM fa WHERE fa.query_id = p.query_id AND fa.key = p.key) OR EXISTS (SELECT 1 FROM ft WHERE ft.query_id = p.query_id AND ft.key = p.key)) AS has_text FROM p WHERE position <= 8)
SELECT q.query_id, round(coalesce(0.5 * avg((n_lists >= 2)::INT) + 0.3 * max(has_text::INT) + 0.2 * least(1.0, (max(score) - min(score)) / max(score)), 0.0), 9) AS confidence FROM q LEFT JOIN r USING (query_id) GROUP BY q.query_id""")
def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, lists = hybrid_lists(spark, sf_dir)
    return fusion.confidence(asked, fusion.fuse_rows(lists), ["all_fts", "tenant_fts"]).select("query_id", F.round("confidence", 9).alias("confidence"))


def hybrid_corpora(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, docs, tickets): all documents, those with vectors have them; odd ids are docs, even ids tickets, and the held-out tickets with a vector ask."""
    rows = T.texts(spark, sf_dir).join(T.vectors(spark, sf_dir).drop("tenant_id"), "key", "left").withColumn("is_held_out", hashing.is_held_out(F.col("key")))
    held = rows.where("key % 2 = 0")
    asked = held.where("is_held_out AND vec IS NOT NULL").select(F.col("key").alias("query_id"), F.col("vec").alias("qvec"), fulltext.query_terms(F.col("text")).alias("terms"), "tenant_id")
    return asked, rows.where("key % 2 = 1"), held


def _sql_list(name: str, score: str, source: str, on: str) -> str:
    """One ranked list: the 20 best keys a query."""
    return f"{name} AS (SELECT query_id, prefix || key AS key, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, k) AS rank FROM (SELECT q.query_id, '{source}:' AS prefix, c.key AS key, c.key AS k, {score} AS s FROM {on}) QUALIFY rank <= 20)"


_HELD = "('0x' || substr(sha256('heldout:' || key), 1, 16))::UBIGINT % 10 = 0"
SQL_CORPORA = rf"""{T.SQL_VECTORS.split(', q AS (')[0]}, r AS (SELECT key, vec, tenant_id, text, {_HELD} AS held FROM (SELECT doc_id AS key, {T.SQL_TENANT.format('doc_id')} AS tenant_id, text FROM documents) LEFT JOIN (SELECT key, vec FROM v) USING (key)), q AS (SELECT key AS query_id, vec AS qvec, tenant_id, text FROM r WHERE key % 2 = 0 AND held AND vec IS NOT NULL),
docs AS (SELECT * FROM r WHERE key % 2 = 1), tick AS (SELECT * FROM r WHERE key % 2 = 0 AND NOT held AND vec IS NOT NULL),
b AS (SELECT query_id, tenant_id, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1, 2000) ELSE '' END AS body FROM q), {SQL_TERMS.split('FROM benchmark),', 1)[1]}, {SQL_POSTINGS},
hits AS (SELECT t.query_id, idx.key, any_value(t.tenant_id) AS qt, sum(tf) AS hits FROM terms t JOIN idx ON t.token = idx.token GROUP BY t.query_id, idx.key),
{_sql_list('dv', 'round(list_cosine_similarity(q.qvec, c.vec), 9)', 'docs', 'q JOIN docs c ON c.vec IS NOT NULL')}, {_sql_list('tv', 'round(list_cosine_similarity(q.qvec, c.vec), 9)', 'tickets', 'q JOIN tick c ON q.tenant_id = c.tenant_id')},
{_sql_list('df', 'q.hits', 'docs', 'hits q JOIN docs c ON q.key = c.key')}, {_sql_list('tf', 'q.hits', 'tickets', 'hits q JOIN tick c ON q.key = c.key AND q.qt = c.tenant_id')},
{_fused('SELECT * FROM dv UNION ALL SELECT * FROM tv UNION ALL SELECT * FROM df UNION ALL SELECT * FROM tf')}"""


SQL_TWO_CORPORA = f"WITH {SQL_CORPORA} SELECT query_id, p.key, split_part(p.key, ':', 1) AS corpus, round(score, 9) AS score, position, length(text)::INT AS n_chars FROM p JOIN r ON r.key = split_part(p.key, ':', 2)::BIGINT WHERE position <= 8"


@register("hybrid_two_corpora", SQL_TWO_CORPORA)
def hybrid_two_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lists over two corpora under the tenant filter."""
    return hybrid.hybrid_search(*hybrid_corpora(spark, sf_dir)).select("query_id", "key", "corpus", F.round("score", 9).alias("score"), "position", F.length("text").alias("n_chars"))


@register("hybrid_indexed", SQL_TWO_CORPORA)
def hybrid_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by kept full-text indexes of both corpora."""
    asked, docs, held = hybrid_corpora(spark, sf_dir)
    index = lambda name: posindex.KeptIndex(spark, table_path(spark, f"{name}-index"))
    kept = {"docs": index("docs").append(docs, 0), "tickets": hybrid.ticket_index(index("tickets"), held)}
    return hybrid.hybrid_search(asked, docs, held, indexes=kept).select("query_id", "key", "corpus", F.round("score", 9).alias("score"), "position", F.length("text").alias("n_chars"))


@register("hashed_vectors")
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.texts(spark, sf_dir).select("key", fulltext.tokens(F.col("text")).alias("tokens"))
    return vector.hashed_embedding(rows, "key", "tokens")
