"""Traces that replace on conflict, and budgets kept as state."""

import os

import pytest
from pyspark.sql import functions as F

from tallyproof.streaming import runs

STEPS = "run_id string, seq int, node string, tool string, s int"


def put(spark, path, n, rows):
    spark.createDataFrame(rows, "run_id string, seq int, detail string, written_at bigint").coalesce(1).write.parquet(f"{path}/{n:03d}")


def trace_of(spark, out):
    return sorted((r.run_id, r.seq, r.detail) for r in runs.current(spark, out, ["run_id", "seq"]).collect())


def test_replayed_batches_change_nothing_and_reads_stay_small(spark, tmp_path):
    out, key = str(tmp_path / "trace"), ["run_id", "seq"]
    rows = lambda pairs: spark.createDataFrame(pairs, "run_id string, seq int, detail string, written_at bigint")
    assert runs.current(spark, out, key) is None
    want = {}
    batches = [[(f"r{i % 3}", j, f"b{i}-{j}", i) for j in range(i % 4 + 1)] for i in range(10)]
    for i, b in enumerate(batches):
        for _ in range(2 if i % 3 == 0 else 1):  # some batches are written again after a failure
            runs.write_batch(rows(b), i, out, key, compact=4)
        want |= {(r, s): d for r, s, d, _ in b}
        assert trace_of(spark, out) == sorted((*k, d) for k, d in want.items())
    runs.write_batch(rows([("r0", 0, "stale", 99)]), 2, out, key, compact=4)  # in the base already
    assert trace_of(spark, out) == sorted((*k, d) for k, d in want.items())
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) <= 8 and len([d for d in os.listdir(out) if d.startswith("base=")]) <= 2


def test_the_last_row_of_a_batch_counts(spark, tmp_path):
    out = str(tmp_path / "trace")
    runs.write_batch(spark.createDataFrame([("r", 1, "old", 1), ("r", 1, "new", 2), (None, 1, "n", 1)], "run_id string, seq int, detail string, written_at bigint"), 0, out, ["run_id", "seq"])
    assert sorted(((r.run_id or "", r.detail) for r in runs.current(spark, out, ["run_id", "seq"]).collect())) == [("", "n"), ("r", "new")]


def test_a_stream_that_stops_and_goes_on(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put(spark, src, 0, [("r", 1, "a", 1), ("r", 2, "b", 1)])
    live = lambda: spark.readStream.schema("run_id string, seq int, detail string, written_at bigint").parquet(f"{src}/*")
    runs.upsert_trace(live(), out, ck, ["run_id", "seq"]).awaitTermination()
    put(spark, src, 1, [("r", 2, "B", 2), ("q", 1, "c", 2)])
    runs.upsert_trace(live(), out, ck, ["run_id", "seq"]).awaitTermination()
    runs.upsert_trace(live(), out, ck, ["run_id", "seq"]).awaitTermination()
    assert trace_of(spark, out) == [("q", 1, "c"), ("r", 1, "a"), ("r", 2, "B")]


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_runs_end_by_node_budget_or_time(spark, tmp_path, rocksdb):
    """Three starts of one query: budgets, repeated and late steps, a run that falls silent, and stragglers after its end."""
    src, ck, out = (str(tmp_path / x) for x in ("in", "ck", "out"))

    def feed(n, rows):
        table = spark.createDataFrame(rows, STEPS)
        table.select("run_id", "seq", "node", "tool", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at")).coalesce(1).write.parquet(f"{src}/{n}")
        steps = spark.readStream.schema("run_id string, seq int, node string, tool string, at timestamp").parquet(f"{src}/*")
        ended = runs.run_budgets(steps, {"steps": 4, "tool_calls": 2}, limit_seconds=60, late="30 seconds")
        ended.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.run_id, r.status, r.reason, r.steps, r.tool_calls) for r in spark.read.parquet(out).collect())

    first = [("done", 1, "GUARD", None, 0), ("done", 2, "SEARCH", "s", 1), ("done", 2, "SEARCH", "s", 1), ("calls", 1, "SEARCH", "s", 0), ("calls", 2, "SEARCH", "s", 1), ("silent", 1, "GUARD", None, 2), (None, 1, "GUARD", None, 0)]
    assert feed(1, first) == []
    second = [("done", 3, "ANSWER", None, 5), ("calls", 3, "EVIDENCE", "e", 6), ("calls", 4, "ANSWER", None, 7), *[("steps", i, "EVIDENCE", None, 5 + i) for i in range(1, 8)], ("slow", 1, "GUARD", None, 8), ("slow", 2, "SEARCH", "s", 70)]
    got = feed(2, second)
    assert got == [("calls", "ABORT", "BUDGET_EXCEEDED", 3, 3), ("done", "ANSWER", None, 3, 1), ("slow", "ABORT", "TIME_LIMIT", 1, 0), ("steps", "ABORT", "BUDGET_EXCEEDED", 5, 0)]
    got2 = feed(3, [("late", 1, "GUARD", None, 3), ("clock", 1, "GUARD", None, 200), ("silent", 9, "ANSWER", None, 199)])
    assert [r for r in got2 if r[0] == "silent"] == [("silent", "ABORT", "TIME_LIMIT", 1, 0)] and not [r for r in got2 if r[0] in ("late", "clock")]
    assert len(got2) == 5
