"""Queries on records and files against their SQL, and what SQL can't express beside them."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import scoring
from tidemark.operators import vector
from tidemark.plans import records, registry

OWN = sorted(n for n, f in registry.queries().items() if f.__module__ == records.__name__)
TABLES = ("customer", "documents", "embeddings", "events", "lineitem", "nation", "orders", "conversations")


def plain(value):
    return [plain(v) for v in value] if isinstance(value, list) else round(value, 9) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    want = sorted((str([plain(v) for v in r]) for r in want.fetchall()))
    got = __spark_entry__.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str([plain(r[c]) for c in names]) for r in got.collect()) == want


def test_degraded_stages_are_independent(spark):
    rows = spark.createDataFrame([(True, False), (False, False), (True, True), (None, True)], "a boolean, b boolean")
    got = [(r.d.degraded, r.d.stages) for r in rows.select(scoring.degraded({"triage": F.col("a"), "draft": F.col("b")}).alias("d")).collect()]
    assert got == [(True, ["triage"]), (False, []), (True, ["triage", "draft"]), (True, ["draft"])]


def test_hashed_embedding(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "a", "a"]), (3, []), (4, ["c"]), (5, ["a"])], "key bigint, tokens array<string>")
    got = {r.key: r.embedding for r in vector.hashed_embedding(rows, "key", "tokens", 512).collect()}
    assert got[1] == got[2] and not any(got[3]) and all(len(v) == 512 for v in got.values())
    assert all(math.isclose(sum(x * x for x in got[k]), 1, rel_tol=1e-5) for k in (1, 2, 4, 5))
    cosine = lambda a, b: sum(x * y for x, y in zip(got[a], got[b], strict=True))
    assert math.isclose(cosine(1, 5), 2 / math.sqrt(5), rel_tol=1e-5) and abs(cosine(1, 4)) < 1e-6


def test_entry_without_a_tokenizer_library(monkeypatch):
    """The other queries stay when the library of the training-data operators is missing."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); print('rrf_fusion' in q, any(n.startswith('op') and n[2:3].isdigit() for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__spark_entry__.__file__).parent, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["True", "False"]
