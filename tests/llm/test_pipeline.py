"""The pipeline against its stages' brute-force versions, and the registered queries."""

import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
import pytest

from tests.llm.test_operators import brute_classes
from tidemark.llm import mixing, quality


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality.score(docs, ["doc_id"]).where("kept").collect()}
    table = sorted(tuple(r) for r in docs.collect() if r.doc_id in kept)
    first = {table[k][0] for k in set(brute_classes(table))}
    table = [r for r in table if r[0] in first]
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda t: {tuple(w[i : i + 5]) for w in [split(t)] for i in range(len(w) - 4)}
    items = [grams(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    table = [r for r in table if not any(g and len(g & grams(r[1])) >= 0.8 * len(g) for g in items)]
    mixed = Counter({r.doc_id: len(r.draws) for r in mixing.shares(spark.createDataFrame(table, docs.schema)).collect()})
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert Counter(r.doc_id for r in rows) == Counter({k: n for k, n in mixed.items() if n})
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 0, name


@pytest.mark.parametrize("n", range(1, 11))
def test_each_operator_has_a_query(n):
    assert sum(q.startswith(f"op{n}_") for q in __spark_entry__.queries()) == 1


def test_ranges_of_shards_need_no_python_worker(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.llm import sharding

    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 90, 2560):
        splitters = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        keys = [*rng.integers(-(1 << 63), (1 << 63) - 1, 300).tolist(), *splitters[:50].tolist(), -(1 << 63), (1 << 63) - 1]
        rows = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("r", sharding._range_of("k", splitters))
        assert [r.r for r in rows.collect()] == np.searchsorted(splitters, np.array([r.k for r in rows.select("k").collect()], np.int64), "right").tolist()
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString() and rows.schema["r"].dataType.simpleString() == "int"
