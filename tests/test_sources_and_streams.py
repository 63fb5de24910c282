"""Sources, sinks and streams; the registry; imports without the training-data part."""

import json
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from tidemark.plans import tables
from tidemark.sources import files
from tidemark.streaming import feed, telemetry


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.md").write_text("---\ntitle: X\n---\ntext")
    (tmp_path / "a/b/y.md").write_text("---\ndraft: true\n---\ntext")
    (tmp_path / "z.txt").write_text("no")
    assert [r.path for r in files.markdown_tree(spark, str(tmp_path)).collect()] == ["a/x.md"]
    assert sorted(r.path for r in files.markdown_tree(spark, str(tmp_path), drafts=True).collect()) == ["a/b/y.md", "a/x.md"]


def test_caches_sheets_artifacts_and_feeds(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"u1": {"caption": "one", "ticket": 3}, "u2": {"caption": None, "error": "x"}}))
    got = {r.key: (r.caption, r.ticket, r.error) for r in files.read_cache(spark, str(tmp_path / "c.json"), "caption:string,ticket:bigint,error:string").collect()}
    assert got == {"u1": ("one", 3, None), "u2": (None, None, "x")}
    assert [r.name for r in files.read_artifacts(spark, str(tmp_path)).collect()] == ["c.json"]
    df = spark.createDataFrame([(1, 'a "b"\nc, d'), (2, "é")], "n int, t string")
    files.write_sheet(df, str(tmp_path / "s"))
    assert sorted(map(tuple, files.read_sheet(spark, str(tmp_path / "s"), "n int, t string").collect())) == [(1, 'a "b"\nc, d'), (2, "é")]
    (tmp_path / "feed.txt").write_text("1\tM\tc/a.md\n2\tR100\tc/a.md\tc/b.md\nbad\n")
    assert [tuple(r) for r in files.read_changes(spark, str(tmp_path / "feed.txt")).collect()] == [(1, "M\tc/a.md"), (2, "R100\tc/a.md\tc/b.md")]


def test_batch_equals_stream(spark, sf_dir):
    """Closed windows of the rows in time are those of a batch over them."""
    from tidemark.plans.live import _events

    streamed = __spark_entry__.queries()["stream_counts"](spark, sf_dir)
    rows = _events(spark, sf_dir)
    mark = {k: rows.where(F.col("arrival") < k).agg(F.max("ts")).first()[0] for k in (1, 2)}
    late = F.lit(False)
    for k, at in mark.items():
        late = F.when(F.col("arrival") == k, F.col("ts") < F.lit(at) - F.expr("INTERVAL 10 minutes")).otherwise(late)
    batch = telemetry.counts(telemetry.timed(rows.where(~late)), ["route", "degraded"])
    last = F.date_trunc("minute", F.lit(rows.where(~late).agg(F.max("ts")).first()[0]))
    batch = batch.where(F.col("window_start") + F.expr("INTERVAL 11 minutes") <= last).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    assert streamed.exceptAll(batch).count() == batch.exceptAll(streamed).count() == 0 and 0 < batch.count() < rows.count()


def test_late_rows_are_dropped(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "ts timestamp_ntz, route string")
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def push(*x):
        rows(*x).coalesce(1).write.mode("append").parquet(src)
        stream = telemetry.counts(telemetry.timed(spark.readStream.schema("ts timestamp_ntz, route string").parquet(src)), ["route"])
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    import datetime as d

    at = lambda m: d.datetime(2024, 1, 1, 0, 0) + d.timedelta(minutes=m)
    push((at(0), "a"), (at(30), "a"))
    push((at(1), "late"), (at(60), "a"))
    got = {(r.window_start, r.route): r.n for r in spark.read.parquet(out).collect()}
    assert got == {(at(0), "a"): 1, (at(30), "a"): 1}


def test_feed_can_be_replayed(spark, sf_dir, tmp_path):
    changes = tables.changes(spark, sf_dir).where("seq < 60")
    for part in ("seq < 20", "seq < 40", "seq < 40", "seq < 60"):
        feed.apply_batch(changes.where(part), str(tmp_path / "log"))
    from tidemark.operators import replay

    got = spark.read.parquet(str(tmp_path / "log/ledger")).select("seq", "path", "chunks_before", "chunks_after")
    want = replay.ledger(changes).select("seq", "path", "chunks_before", "chunks_after")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_batch_cut_off_is_replayed(spark, tmp_path, monkeypatch):
    """A batch that dies before its heads are written leaves no row behind, also when all pages of a bucket go."""
    from tidemark.operators import replay

    rows = [(0, "added", "a", None, 3, "x"), (1, "added", "b", None, 2, "y"), (2, "deleted", "a", None, 0, None), (3, "renamed", "c", "b", 5, "z"), (4, "added", "a", None, 1, "w"), (5, "modified", "c", None, 4, "v")]
    changes, log = spark.createDataFrame(rows, feed.CHANGE), str(tmp_path / "log")
    feed.apply_batch(changes.where("seq < 2"), log, buckets=4)
    with monkeypatch.context() as m:
        m.setattr(replay, "view", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            feed.apply_batch(changes.where("seq < 5"), log, buckets=4)
    assert feed.read_ledger(spark, log).count() == 2
    for part in ("seq < 4", "seq < 5", "seq < 6", "seq < 6"):
        feed.apply_batch(changes.where(part), log, buckets=4)
    got = sorted((r.seq, r.path, r.chunks_before, r.chunks_after) for r in feed.read_ledger(spark, log).collect())
    assert got == [(0, "a", 0, 3), (1, "b", 0, 2), (2, "a", 3, 0), (3, "c", 2, 5), (4, "a", 0, 1), (5, "c", 5, 4)]


def test_shuffled_feed_gives_the_ordered_ledger(spark, sf_dir, tmp_path):
    """Changes in any order, some twice, some without effect: none is lost, and what waits can be seen."""
    import random

    from tidemark.operators import replay

    rows = [tuple(r) for r in tables.changes(spark, sf_dir).where("seq < 80").select(*feed._columns(feed.CHANGE)).collect()]
    rows = [(r[0], None, None, None, None, None) if r[0] % 17 == 4 else r for r in rows]
    want = replay.ledger(spark.createDataFrame([r for r in rows if r[1]], feed.CHANGE)).select("seq", "path", "chunks_before", "chunks_after")
    shuffled = rows + rows[5:12]
    random.Random(4).shuffle(shuffled)
    log, seen = str(tmp_path / "log"), []
    for k in range(0, len(shuffled), 22):
        feed.apply_batch(spark.createDataFrame(shuffled[k : k + 22], feed.CHANGE), log)
        seen += shuffled[k : k + 22]
        numbers = {r[0] for r in seen}
        done = next(i for i in range(81) if i not in numbers)
        assert {r.seq for r in feed.read_waiting(spark, log).collect()} == {n for n in numbers if n > done}
        assert feed.read_ledger(spark, log).count() == sum(1 for r in rows if r[0] < done and r[1])
    got = feed.read_ledger(spark, log).select("seq", "path", "chunks_before", "chunks_after")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and feed.read_waiting(spark, log).isEmpty()
    feed.apply_batch(spark.createDataFrame(rows[:3], feed.CHANGE), log)
    assert {r.seq for r in spark.read.parquet(f"{log}/repeated").collect()} >= {0, 1, 2} and feed.read_ledger(spark, log).count() == want.count()


def test_arriving_tickets(spark, tmp_path):
    spark.createDataFrame([("dns fails", "conntrack")], "title string, body string").write.json(str(tmp_path / "in"))
    seen = []
    feed.serve(spark.readStream.schema("title string, body string").json(str(tmp_path / "in")), str(tmp_path / "state"), lambda df: seen.extend(df.collect())).awaitTermination()
    assert seen[0].triage.component == "sig/network" and seen[0].body_chars == 9


def test_bucket_quantile(spark):
    r = spark.range(1).select(telemetry.bucket_quantile(F.array(F.lit(0), F.lit(10), F.lit(20), F.lit(20)), 0.75, (1.0, 2.0, 4.0)).alias("a"), telemetry.bucket_quantile(F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(5)), 0.5, (1.0, 2.0, 4.0)).alias("b"), telemetry.bucket_quantile(F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(0)), 0.5, (1.0, 2.0, 4.0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (3.0, 4.0, None)


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["query_id", "key", "score", "position", "n_lists"] and rows.count() > 0


def test_imports_without_the_training_data_part(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    subprocess.run(["cp", "-r", str(root / "tidemark"), str(root / "__spark_entry__.py"), str(tmp_path)], check=True)
    if (tmp_path / "tidemark/llm").exists():
        (tmp_path / "tidemark/llm").rename(tmp_path / "away")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries())[:1], any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.strip().endswith("False"), said.stderr


@pytest.mark.parametrize("name", ["rrf_fusion", "replay_current"])
def test_plans_prune_columns_and_rank_by_window_limit(spark, sf_dir, name, capsys):
    __spark_entry__.queries()[name](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
