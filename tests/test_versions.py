"""Kept versions against replaying the log."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replay, versions

SCHEMA = "seq bigint, change_type string, path string, old_path string, n_chunks bigint, payload string"


def log(n=240, seed=6):
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        kind, page = r.choice(["added", "modified", "modified", "deleted", "renamed"]), f"p{r.randrange(15)}"
        rows.append((seq, kind, f"p{r.randrange(15)}" if kind == "renamed" else page, page if kind == "renamed" else None, r.randrange(1, 9), f"v{seq}"))
    return rows


@pytest.fixture(scope="module")
def changes(spark):
    return spark.createDataFrame(log(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(f"p{i}", i + 1, f"base{i}") for i in range(0, 20, 2)], "path string, n_chunks bigint, payload string").cache()


def state(df):
    return sorted((r.path, r.n_chunks, r.payload) for r in df.collect())


def test_every_state_equals_the_replay(spark, changes, base, tmp_path):
    kept = versions.Versions(spark, str(tmp_path / "v"))
    kept.append(changes.where("seq < 100"), base, step=40).append(changes.where("seq < 100")).append(changes, step=60)
    assert [(a, b) for a, b, _ in kept.layers()] == [(0, 40), (40, 80), (80, 100), (100, 160), (160, 220), (220, 240)]
    points = (0, 1, 39, 40, 41, 79, 99, 100, 150, 219, 239)
    want = {s: state(replay.view(changes, base, as_of=s)) for s in points}
    assert {s: state(kept.as_of(s)) for s in points} == want
    assert state(kept.as_of(-1)) == state(base) and state(kept.as_of(999)) == want[239]
    kept.compact(40, 100)
    assert [(a, b) for a, b, _ in kept.layers()] == [(0, 40), (40, 100), (100, 160), (160, 220), (220, 240)]
    assert {s: state(kept.as_of(s)) for s in points} == want
    kept.compact(0, 240)
    assert len(kept.layers()) == 1 and {s: state(kept.as_of(s)) for s in points} == want
    with pytest.raises(ValueError):
        kept.compact(0, 100)


def test_a_state_opens_one_layer(spark, changes, tmp_path):
    kept = versions.Versions(spark, str(tmp_path / "v")).append(changes, step=30)
    files = {f for f in kept.as_of(100).inputFiles()}
    assert len(kept.layers()) == 8 and files and all("layer-90-" in f for f in files)


def test_history_of_a_page(spark, changes, tmp_path):
    kept = versions.Versions(spark, str(tmp_path / "v")).append(changes, step=50)
    for page in ("p3", "p7"):
        rows = sorted(tuple(r) for r in kept.history(page).collect())
        for s in range(0, 240, 13):
            live = [(n, d) for since, until, n, d in rows if since <= s < until]
            assert live == [(r.n_chunks, r.payload) for r in replay.view(changes, as_of=s).where(F.col("path") == page).collect()]
        assert all(a[1] <= b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_nothing_to_append(spark, changes, tmp_path):
    kept = versions.Versions(spark, str(tmp_path / "v")).append(changes.limit(0))
    assert kept.layers() == []
    with pytest.raises(ValueError):
        kept.as_of(3)
