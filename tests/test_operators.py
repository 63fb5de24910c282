"""Operators: chunking, retrieval, replay, tickets, evaluation, checks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, chunking, evaluation, fulltext, fusion, hybrid, replay, tickets, topk, vector

PAGE = """---
title: "Pods"
draft: false
---
Intro with {{< glossary_tooltip text="node" term_id="n" >}} and
a multi {{< note
>}} tag.

## One
{{% alert %}}Body stays.{{% /alert %}} ![x](img.png)

| a | b |
|---|---|
| 1 | 2 |
After the table.
```yaml
## not a heading
{{ template }}
```
### Deep <!-- gone -->
text of deep
# Top again
last
"""


def plain_chunks(markdown, most):
    """A line-by-line chunker to compare with: (section, body)."""
    import re

    body = re.sub(r"(?s)\A\s*---[ \t]*\n.*?\n---[ \t]*\n+", "", markdown)
    lines, prose, inside = [], [], False

    def strip(t):
        for p in (r'\{\{<\s*glossary_tooltip\b[^>]*?text="([^"]+)"[^>]*?>\}\}', r'\{\{<\s*glossary_tooltip\b[^>]*?term_id="([^"]+)"[^>]*?>\}\}', r'\{\{<\s*figure\b[^>]*?caption="([^"]+)"[^>]*?>\}\}'):
            t = re.sub(p, r"\1", t)
        return re.sub(r"(?s)<!--.*?-->", "", re.sub(r"\{\{[<%][^>%]*?[>%]\}\}", "", t))

    def out():
        if prose:
            lines.extend((x, False) for x in strip("\n".join(prose)).split("\n"))
            prose.clear()

    for line in body.split("\n"):
        if line.lstrip().startswith("```"):
            out()
            lines.append((line, True))
            inside = not inside
        elif inside:
            lines.append((line, True))
        else:
            prose.append(line)
    out()
    groups, h2, h3, now = [], "", "", ("", [])
    for line, code in lines:
        m = None if code else re.match(r"(#{1,6})\s+(.*)$", line)
        if not m:
            now[1].append((line, code))
            continue
        groups.append(now)
        if len(m[1]) <= 2:
            h2, h3 = m[2].strip(), ""
        else:
            h3 = m[2].strip()
        now = (f"{h2} / {h3}" if h2 and h3 else h3 or h2, [])
    groups.append(now)
    chunks = []
    for section, own in groups:
        blocks, block, kind = [], [], None
        for line, code in [*own, ("", False)]:
            mine = "code" if code else "blank" if not line.strip() else "row" if line.lstrip().startswith("|") else "text"
            opens = mine == "code" and line.lstrip().startswith("```") and (kind != "code" or sum(x.lstrip().startswith("```") for x in block) == 2)
            if mine != kind or opens:
                if block and "\n".join(block).strip():
                    blocks.append("\n".join(block).strip())
                block, kind = [], mine
            if mine != "blank":
                block.append(line)
        size, held = 0, []
        for b in blocks:
            if held and size + len(b) > most:
                chunks.append((section, "\n\n".join(held)))
                held, size = [], 0
            held.append(b)
            size += len(b) + 2
        if held:
            chunks.append((section, "\n\n".join(held)))
    return chunks


def random_page(seed):
    r = random.Random(seed)
    parts = []
    for _ in range(r.randrange(3, 25)):
        parts.append(r.choice([lambda: "#" * r.randrange(1, 5) + f" h{r.randrange(9)}", lambda: "| a | b |", lambda: "", lambda: " ".join(["word"] * r.randrange(1, 60)), lambda: "```\n# no\n\n| x\n```", lambda: '{{< glossary_tooltip text="t" >}} x', lambda: "<!-- c -->", lambda: "   "])())
    return "---\ntitle: T\n---\n" + "\n".join(parts)


def test_chunks_match_a_line_by_line_chunker(spark):
    pages = [("a.md", PAGE)] + [(f"p{i}.md", random_page(i)) for i in range(40)] + [("empty.md", ""), ("big.md", "---\ntitle: B\n---\n" + "\n\n".join(["y" * 500] * 12))]
    got = {}
    for r in chunking.chunk_pages(spark.createDataFrame(pages, "path string, markdown string")).collect():
        got.setdefault(r.path, []).append(r)
    for path, markdown in pages:
        want = plain_chunks(markdown, 1600)
        mine = sorted(got.get(path, []), key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in mine] == list(range(len(want))), path
        title = {"a.md": "Pods", "big.md": "B"}.get(path, "T" if path.startswith("p") else path)
        assert [(r.section, r.text) for r in mine] == [(s, (f"{title} / {s}" if s else title) + f"\n\n{b}") for s, b in want], path
    assert len(got["big.md"]) > 1 and all(r.n_chars <= 1800 for r in got["big.md"])
    table = chunking.page_table(spark.createDataFrame(pages[:1], "path string, markdown string"), chunking.chunk_pages(spark.createDataFrame(pages[:1], "path string, markdown string")), "v").first()
    assert (table.title, table.has_images, table.n_chunks) == ("Pods", True, len(plain_chunks(PAGE, 1600)))


def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[10] = x[11]
    x[12] = 0
    rows = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "key bigint, vec array<float>, tenant_id int")
    asked = rows.where("key < 15").select(F.col("key").alias("query_id"), F.col("vec").alias("qvec"), "tenant_id")
    norm = np.linalg.norm(x.astype(float), axis=1)
    unit = np.divide(x, norm[:, None], where=norm[:, None] > 0, out=np.zeros(x.shape))
    sims = np.round(unit @ unit.T, 9)
    for same in (False, True):
        got = {}
        for r in vector.exact_top(asked, rows, k=7, same_tenant=same).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.key))
        for q in range(15):
            pool = [k for k in range(300) if not same or k % 5 == q % 5]
            want = sorted(pool, key=lambda k: (-sims[q, k], k))[:7]
            assert [k for _, k in sorted(got[q])] == want
    want = vector.exact_top(asked, rows, k=7).collect()
    monkeypatch.setattr(topk, "SENT_ROWS", 0)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vector, "CORPUS_BLOCK", 64)
    assert sorted(vector.exact_top(asked, rows, k=7).collect()) == sorted(want)


def test_cells_reach_recall(spark, sf_dir):
    from tidemark.plans import tables

    corpus = tables.vectors(spark, sf_dir)
    asked = tables.vector_queries(corpus)
    index = vector.CellIndex(corpus)
    cells, exact = index.assign(corpus), vector.exact_top(asked, corpus)
    assert cells.count() == corpus.count()
    found = index.top(asked, cells, probes=index.calibrate(asked, cells, exact))
    assert vector.recall(found, exact).first().recall >= 0.9


def test_blocks_of_a_hot_cell_are_bounded(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(600, 8))
    x[:200] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, vec array<double>")
    asked = rows.select(F.col("key").alias("query_id"), F.col("vec").alias("qvec"))
    index = vector.CellIndex(rows, cells=4)
    cells = index.assign(rows)
    want = index.top(asked, cells, k=7, probes=4).collect()
    monkeypatch.setattr(topk, "SENT_ROWS", 0)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 32)
    monkeypatch.setattr(vector, "CORPUS_BLOCK", 64)
    assert sorted(index.top(asked, cells, k=7, probes=4).collect()) == sorted(want)
    # no task hands on more than the best rows of one block of each size
    met = vector._in_blocks(asked.withColumn("g", F.lit(0)), rows.withColumn("g", F.lit(0)), k=1000).groupBy("query_id").count()
    assert met.agg(F.max("count")).first()[0] == 600


def test_embedding_runs_once_a_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id int, t string")
    got = {r.id: r.embedding for r in vector.embed(df, "t", lambda texts: [[len(t), 1.0] for t in texts], 2).collect()}
    assert got == {1: [1, 1], 2: [2, 1], 3: [1, 1], 4: None}


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("Pods stuck in the Pending state", ["pods", "stuck", "pending", "state"]), ("what is this", []), ("Title here\nuse `kubectl get` with --dry-run and podSpec.nodeName plus FooBar camelCase \"not found here\"", ["title", "here", "kubectl", "get", "dry", "run", "podspec", "nodename", "camelcase", "found"]),
        ("x'; DROP TABLE a | b & !c:*", ["drop", "table"]), (" ".join(f"word{i}" for i in range(40)), [f"word{i}" for i in range(15)]), ("", []),
    ],
)
def test_query_terms(spark, query, want):
    assert spark.range(1).select(fulltext.query_terms(F.lit(query)).alias("t")).first().t == want


def test_full_text(spark):
    index = fulltext.postings(spark.createDataFrame([(1, "pod pod node"), (2, "pod"), (3, "node the the"), (4, None)], "key int, text string"))
    asked = spark.createDataFrame([(1, ["pod", "node"]), (2, []), (3, ["absent"])], "query_id int, terms array<string>")
    assert [tuple(r) for r in fulltext.search(asked, index).orderBy("rank").collect()] == [(1, 1, 3, 1), (1, 2, 1, 2), (1, 3, 1, 3)]
    assert [tuple(r) for r in fulltext.search(asked, index, mode="all").collect()] == [(1, 1, 3, 1)]
    assert [fulltext.stem(w) for w in ("running", "pods", "policies", "volumes", "sing")] == ["run", "pod", "policy", "volum", "sing"]


def test_texts_meet_terms_as_postings_do(spark, sf_dir, monkeypatch):
    from tidemark.plans import tables

    asked, docs = tables.text_queries(spark, sf_dir), tables.texts(spark, sf_dir)
    for mode, same in (("any", False), ("all", False), ("any", True)):
        want = sorted(fulltext.search(asked if same else asked.drop("tenant_id"), fulltext.postings(docs, *(["tenant_id"] if same else [])), 5, mode, same).collect())
        assert want and sorted(fulltext.match(asked, docs, 5, mode, same).collect()) == want
    monkeypatch.setattr(topk, "SENT_ROWS", 0)
    assert sorted(fulltext.match(asked, docs, 5, same_tenant=True).collect()) == want
    odd = spark.createDataFrame([(1, []), (2, ["pod"])], "query_id bigint, terms array<string>")
    assert fulltext.match(odd, docs.limit(0)).count() == 0 and fulltext.match(odd.limit(0), docs).count() == 0


def test_best_rows_stay():
    rng = np.random.default_rng(4)
    best, seen = topk.Best(3, 5), []
    for _ in range(20):
        q, v, k = rng.integers(0, 3, 50), rng.integers(0, 9, 50).astype(float), rng.integers(0, 10**6, 50)
        best.add(q, v, k)
        seen += zip(q.tolist(), v.tolist(), k.tolist())
    for q in range(3):
        want = sorted(((v, k) for p, v, k in seen if p == q), key=lambda x: (-x[0], x[1]))[:5]
        assert [(v, k) for p, v, k in zip(best.query.tolist(), best.value.tolist(), best.key.tolist()) if p == q] == want


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_fused_rows_joined_with_themselves(spark, sf_dir, adaptive):
    """The same rows whatever the number of partitions, without any other setting."""
    from tidemark.plans import retrieval

    old, got = spark.conf.get("spark.sql.shuffle.partitions"), set()
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for n in ("1", "4", "8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            fused = retrieval.fused_vectors(spark, sf_dir)
            cites = fused.select("query_id", (F.col("key") + F.when(F.col("position") % 4 == 0, 1000000).otherwise(0)).alias("source"))
            got.add((fusion.cited(fused, cites).count(), fused.count(), fusion.uncovered(cites.withColumn("source", F.col("source").cast("string")), fused).count()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {(150, 200, 50)}


def test_fusion(spark):
    lists = {"a_vector": [(1, "x", 1), (1, "y", 2)], "b_fts": [(1, "x", 1), (1, "z", 2)]}
    fused = fusion.fuse({n: spark.createDataFrame(r, "query_id int, key string, rank int") for n, r in lists.items()}).orderBy("position").collect()
    assert [(r.key, round(r.score, 9)) for r in fused] == [("x", round(2 / 61, 9)), ("y", round(1 / 62, 9)), ("z", round(1 / 62, 9))] and fused[0].ranks == {"a_vector": 1, "b_fts": 1}
    df = spark.createDataFrame(fused)
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: r.confidence for r in fusion.confidence(asked, df, ["b_fts"]).collect()}
    assert got[2] == 0 and got[1] == pytest.approx(0.5 / 3 + 0.3 + 0.2 * (2 / 61 - 1 / 62) / (2 / 61))


def simulate(changes, base):
    pages, log = dict(base), []
    for seq, kind, path, old, n, payload in changes:
        if kind == "deleted":
            log.append((seq, pages.pop(path, (0, None))[0], 0))
        else:
            before = pages.pop(old, (0, None))[0] if kind == "renamed" else pages.get(path, (0, None))[0]
            pages[path] = (n, payload)
            log.append((seq, before, n))
    return pages, log


def test_replay_equals_a_sequential_run(spark):
    r = random.Random(4)
    changes = []
    for seq in range(200):
        kind = r.choice(["added", "modified", "deleted", "renamed"])
        path = f"p{r.randrange(12)}"
        old = r.choice([f"p{i}" for i in range(12) if f"p{i}" != path]) if kind == "renamed" else None
        changes.append((seq, kind, path, old, r.randrange(1, 9), f"c{seq}"))
    base = {"p1": (4, "b1"), "p20": (2, "b20")}
    df = spark.createDataFrame(changes, "seq bigint, change_type string, path string, old_path string, n_chunks bigint, payload string").repartition(5)
    start = spark.createDataFrame([(p, n, c) for p, (n, c) in base.items()], "path string, n_chunks bigint, payload string")
    pages, log = simulate(changes, base)
    assert {x.path: (x.n_chunks, x.payload) for x in replay.view(df, start).collect()} == pages
    assert {x.path for x in replay.view(df, start, as_of=50).collect()} == set(simulate(changes[:51], base)[0])
    assert sorted((x.seq, x.chunks_before, x.chunks_after) for x in replay.ledger(df, start).collect()) == log
    assert [x.seq for x in replay.pending(df, 10, 3).collect()] == [11, 12, 13]


def test_change_lines(spark):
    lines = ["M\tc/a.md", "A\tc/b.md", "D\tc/c.md", "R095\tc/d.md\tc/e.md", "R100\tc/f.md\tblog/f.md", "R100\tblog/g.md\tc/g.md", "M\tother/x.md", "M\tc/x.txt", "junk", "", "R100\tc/h.md"]
    got = replay.classify(spark.createDataFrame(list(enumerate(lines)), "seq int, line string"), "c/").orderBy("seq").collect()
    assert [tuple(r)[1:] for r in got] == [("modified", "c/a.md", None), ("added", "c/b.md", None), ("deleted", "c/c.md", None), ("renamed", "c/e.md", "c/d.md"), ("deleted", "c/f.md", None), ("renamed", "c/g.md", "blog/g.md")]


def test_tickets(spark):
    from tidemark.sources.files import TICKET

    node = lambda n, merged, repo: (n, f"u{n}", merged, (repo,))
    raw = spark.createDataFrame([(1, "t", None, [("sig/b",), ("bug",), ("sig/a",)], "2024-01-02T03:04:05Z", None, "u", [node(5, False, "k/k"), node(6, True, "x/x"), node(7, True, "k/k")]), (2, "t2", "b", None, None, None, "u", [])], TICKET)
    rows = {r.number: r for r in tickets.shape(raw, ["sig/a", "sig/b"], "k/k").collect()}
    assert rows[1].sigs == ["sig/a", "sig/b"] and rows[1].body == "" and rows[1].closing_pr_number == 7 and rows[2].closing_pr_number is None and rows[2].labels == []
    shaped = tickets.derive(tickets.shape(raw, ["sig/a"], "k/k"))
    cache = spark.createDataFrame([(7, "title", "body"), (8, None, "x")], "number bigint, title string, body string")
    assert {r.number: r.closing_pr_title for r in tickets.hydrate(shaped, cache).collect()} == {1: "title", 2: None}
    assert tickets.not_cached(shaped, cache.where("number = 8")).first().number == 7
    ok, bad = tickets.split_valid(spark.createDataFrame([(0, "x"), (50, "x"), (3, " \n"), (None, "x"), (49, "y")], "tenant_id int, title string"))
    assert ok.count() == 2 and bad.count() == 3
    imgs = spark.createDataFrame([(1, "![a](https://x/1) ![b](https://x/2)")], "number bigint, body string")
    got = tickets.captions(imgs, spark.createDataFrame([("https://x/2", "two"), ("https://x/1", "one"), ("https://x/9", None)], "url string, caption string")).first()
    assert got.captions == "one two"
    dirs = spark.createDataFrame([("sig/a", ["net/", "dns/"])], "sig string, dirs array<string>")
    asked = spark.createDataFrame([(1, ["sig/a"], "/docs/net/x"), (2, ["sig/a"], "/docs/x"), (3, [], "/net/"), (4, ["sig/z"], "/net/")], "n int, sigs array<string>, url string")
    assert {r.n: r.in_domain for r in tickets.directory_match(asked, dirs, "n").collect()} == {1: True, 2: False, 3: False, 4: False}
    sheet = spark.createDataFrame([(1, None, None, None), (2, None, None, None), (3, "old", "r", 1)], "ticket_number bigint, degraded string, route string, judge int")
    filled = {r.ticket_number: r for r in tickets.fill_sheet(sheet, spark.createDataFrame([(1, False, "escalate"), (2, True, "escalate")], "ticket_number bigint, degraded boolean, route string"), spark.createDataFrame([(1, 4), (2, 5)], "ticket_number bigint, judge int"), ["judge"]).collect()}
    assert (filled[1].judge, filled[2].judge, filled[3].judge) == (4, None, 1) and filled[3].route == "r" and filled[2].degraded == "true"


def test_hybrid_search_invariants(spark, sf_dir):
    from tidemark.plans.retrieval import hybrid_corpora

    queries, docs, held = hybrid_corpora(spark, sf_dir)
    on = hybrid.hybrid_search(queries, docs, held)
    assert on.columns == ["query_id", "key", "corpus", "score", "ranks", "position", "text"] and on.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 8
    found = on.where("corpus = 'tickets'").withColumn("number", F.expr("try_cast(substring(key, 9) AS bigint)")).join(held.select(F.col("key").alias("number"), F.col("tenant_id").alias("t"), "is_held_out"), "number")
    assert found.where("is_held_out").count() == 0 and found.join(queries.select("query_id", "tenant_id"), "query_id").where("t <> tenant_id").count() == 0 and found.count() > 0
    off = hybrid.hybrid_search(queries, docs, held, tenant_filter=False)
    foreign = off.where("corpus = 'tickets'").withColumn("number", F.expr("try_cast(substring(key, 9) AS bigint)")).join(held.select(F.col("key").alias("number"), F.col("tenant_id").alias("t")), "number").join(queries.select("query_id", "tenant_id"), "query_id")
    assert foreign.where("t <> tenant_id").count() > 0


def test_evaluation(spark):
    results = spark.createDataFrame([(1, 1, "own"), (1, 2, "no"), (1, 3, "yes"), (2, 1, "no"), (3, 1, "yes"), (3, 9, "yes")], "query_id int, position int, kind string")
    ranks = evaluation.first_ranks(results, F.col("kind") == "yes", F.col("kind") == "own")
    assert {r.query_id: r.first_rank for r in ranks.collect()} == {1: 2, 2: None, 3: 1}
    s = evaluation.rank_summary(ranks).first()
    assert (s.n, s.hits, s.median_rank) == (3, 2, 2) and s.mrr == pytest.approx(0.5)
    leak = evaluation.leakage(spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 3, 3)], "query_id int, query_tenant int, key_tenant int")).first()
    assert (leak.n_results, leak.n_foreign, leak.n_queries, leak.n_leaking) == (3, 1, 2, 1)
    h = lambda rows: spark.createDataFrame(rows, "path string, content_hash string")
    changes = spark.createDataFrame([("modified", "a"), ("modified", "b"), ("modified", "c"), ("deleted", "d"), ("modified", "a")], "change_type string, path string")
    served = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "query_id int, path string")
    st = evaluation.staleness(h([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")]), h([("a", "2"), ("b", "1")]), changes, served, n_queries=4).first()
    assert (st.n_modified, st.n_stale_pages, st.n_missing, st.n_served, st.share) == (3, 1, 1, 1, 0.25)
    assert evaluation.health_gate(results, F.col("kind") == "no", 3) == 2
    with pytest.raises(RuntimeError):
        evaluation.health_gate(results, F.col("kind") == "no", 1)
    assert tuple(evaluation.tenant_counts(spark.createDataFrame([(0,), (0,), (2,)], "tenant_id int"), 4).first()) == (4, 0, 2, 0.75)


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", True), (1, None, False), (2, "z", True)], "k int, t string, is_held_out boolean")
    assert checks.repeated_keys(df, "k").first().n == 2 and checks.outside(df, "t", ["a"]).count() == 2 and [tuple(r) for r in checks.missing(df, "k", "t").collect()] == [("t", 1)]
    with pytest.raises(ValueError):
        checks.held_out_floor(df, 15)
    with pytest.raises(ValueError):
        checks.load_check(df, df.limit(1), "t")
    arts = spark.createDataFrame([("run1", '{"version": "a", "ordinal": 1, "dirty": true}'), ("run2", '{"version": "b", "ordinal": 1, "n": 2}'), ("run3", "{"), ("other", "{}")], "name string, body string")
    got = sorted((r.name, r.problem) for r in checks.artifact_problems(arts, {"run": ["n"]}).collect())
    assert got == [("*", "repeated ordinal 1"), ("*", "several versions"), ("run1", "dirty tree"), ("run1", "lacks n"), ("run3", "no JSON")]


@pytest.mark.parametrize("sent_rows", [8192, 0])
def test_rows_without_tenant_are_in_lists_over_all(spark, monkeypatch, sent_rows):
    """Both ways give the lists of the single forms, whatever the size of the batch."""
    monkeypatch.setattr(topk, "SENT_ROWS", sent_rows)
    corpus = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0], "red red blue" if i % 2 else "blue green", None if i % 3 == 0 else i % 2) for i in range(40)], "key long, vec array<double>, text string, tenant_id int").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 1.0], ["red", "green"], 1), (2, [0.0, 1.0, 1.0], ["blue"], None), (3, [2.0, 2.0, 1.0], [], 0)], "query_id long, qvec array<double>, terms array<string>, tenant_id int")
    lists = {"all": False, "tenant": True}
    for many, one, value in (
        (vector.exact_lists(asked, corpus, lists, 6), lambda same: vector.exact_top(asked, corpus, 6, same), "similarity"),
        (fulltext.match_lists(asked, corpus, lists, 6), lambda same: fulltext.match(asked, corpus, 6, same_tenant=same), "hits"),
    ):
        got = sorted((r.list, r.query_id, r.key, r.rank, round(r[value], 9)) for r in many.collect())
        want = sorted((name, r.query_id, r.key, r["rank"], round(r[value], 9)) for name, same in lists.items() for r in one(same).collect())
        assert got == want and any(g[0] == "all" and g[2] % 3 == 0 for g in got) and not any(g[0] == "tenant" and (g[1] == 2 or g[2] % 3 == 0) for g in got)


def test_chunking_shuffles_nothing(spark, sf_dir, capsys):
    from tidemark.plans import text_prep

    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("markdown"))
    chunking.chunk_pages(raw).explain("formatted")
    assert "Exchange" not in capsys.readouterr().out
    odd = spark.createDataFrame([("a", None), ("a", "one"), ("a", "two"), (None, "# h\n\nx")], "path string, markdown string")
    assert sorted((str(r.path), r.chunk_index, r.section, r.text) for r in chunking.chunk_pages(odd).collect()) == [("None", 0, "h", None), ("a", 0, "", "a\n\none"), ("a", 0, "", "a\n\ntwo")]
    assert text_prep.page_chunks(spark, sf_dir).count() > 0


def test_meeting_many_queries_takes_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    n = 20_000
    asked = pa.table({"query_id": np.arange(n), "g": np.zeros(n, np.int64), "terms": pa.array([["pod", "node"]] * n)})
    terms, best = fulltext.Terms(asked), topk.Best(n, 2)
    code, doc = np.tile([0, 1], 256), np.repeat(np.arange(256), 2)
    tracemalloc.start()
    terms.meet(code, doc, None, np.arange(256), np.zeros(256, np.int64), False, best)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20 and sorted(set(best.key.tolist())) == [0, 1] and len(best.key) == 2 * n


def test_stems_meet_texts_as_postings_do(spark, sf_dir):
    from tidemark.plans import retrieval, tables

    index = fulltext.stemmed(fulltext.postings(tables.texts(spark, sf_dir)))
    want = fulltext.search(fulltext.stemmed_terms(tables.text_queries(spark, sf_dir)), index)
    found = retrieval.fts_stemmed(spark, sf_dir)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and "explode" not in found._jdf.queryExecution().toString()


def test_tokens_split_as_the_pattern_does():
    import pyarrow as pa

    texts = pa.array(["x", "ab", "cd_1 é2f", None, "", "  ", "g-h", "i"])[1:]
    found, doc = fulltext.split(texts)
    assert list(zip(found.to_pylist(), doc.tolist(), strict=True)) == [("ab", 0), ("cd_1", 1), ("2f", 1), ("g", 5), ("h", 5), ("i", 6)]
