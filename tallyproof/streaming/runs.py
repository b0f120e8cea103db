"""Runs as a stream: a trace that replaces on conflict, and budgets that end a run while it goes on.

The trace lies in a folder: `batch=N` holds the rows of micro-batch N, `base=N` the last row of
each key up to batch N. A batch that is written again replaces its own folder, so replays change
nothing; every few batches a base is written, and a reader takes the newest base and the batches
after it, whatever the history. The folder belongs to one checkpoint, whose numbers batches have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.answer import BUDGETS

#: Batches after which a base is written.
COMPACT = 16


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished folders `kind=N`."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: of the last batch, there the greatest by `order`; ties by the row's hash."""
    rest = [c for c in rows.columns if c not in ("batch_no", *key)]
    first = Window.partitionBy(*key).orderBy(F.desc("batch_no"), F.desc(order), F.desc(F.xxhash64(*rest)))
    return rows.withColumn("n_th", F.row_number().over(first)).where("n_th = 1").drop("n_th")


def current(spark: SparkSession, path: str, key: list[str], order: str = "written_at") -> DataFrame | None:
    """The trace: one row a key, with the number of its batch; None before the first batch."""
    bases, batches = _numbers(spark, path, "base"), _numbers(spark, path, "batch")
    upto = bases[-1] if bases else -1
    parts = [f"{path}/base={upto}"] * bool(bases) + [f"{path}/batch={n}" for n in batches if n > upto]
    return _last(spark.read.parquet(*parts), key, order) if parts else None


def write_batch(rows: DataFrame, number: int, path: str, key: list[str], order: str = "written_at", compact: int = COMPACT) -> None:
    """Put micro-batch `number` into the trace; one that is in a base already is left out."""
    spark = rows.sparkSession
    bases = _numbers(spark, path, "base")
    if bases and number <= bases[-1]:
        return
    _last(rows.withColumn("batch_no", F.lit(number).cast("bigint")), key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")
    if number % compact == compact - 1:
        current(spark, path, key, order).write.mode("overwrite").parquet(f"{path}/base={number}")
        # The base before it stays for readers that have begun.
        for n in [b for b in bases[:-1]]:
            _delete(spark, f"{path}/base={n}")
        for n in _numbers(spark, path, "batch"):
            if bases and n <= bases[-1]:
                _delete(spark, f"{path}/batch={n}")


def upsert_trace(rows: DataFrame, path: str, checkpoint: str, key: list[str], order: str = "written_at", compact: int = COMPACT) -> StreamingQuery:
    """Keep a trace of a stream, all that is there, then stop; rows that come again with their key replace the older ones."""

    def put(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, path, key, order, compact)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Nodes that end a run.
ENDS = ("ANSWER", "REFUSE", "ABORT")
OUTCOME = "run_id string, status string, reason string, steps int, tool_calls int, at timestamp"


class _Budget(StatefulProcessor):
    """One run: its distinct steps, tool calls and start; a timer at its limit, then one that clears what is left."""

    def __init__(self, steps: int, tool_calls: int, limit_ms: int):
        self.most = (steps, tool_calls)
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "steps int, tool_calls int, started bigint, timer bigint, ended boolean")
        self.seen = handle.getMapState("seen", "seq int", "at bigint")

    def _timer(self, old: int, new: int) -> int:
        if old != new:
            if old >= 0:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        return new

    def _outcome(self, key, status, reason, steps, calls, at) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "status": [status], "reason": [reason], "steps": [steps], "tool_calls": [calls], "at": [pd.Timestamp(at, unit="ms")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "seq"])  # a run has few rows: those beyond its budget are cut off below
        steps, calls, started, timer, ended = self.run.get() if self.run.exists() else (0, 0, -1, -1, False)
        for at, seq, node, tool in zip(pdf["at"], pdf["seq"], pdf["node"], pdf["tool"]):
            now = int(at.timestamp() * 1000)
            if ended or self.seen.containsKey((int(seq),)):
                continue
            self.seen.updateValue((int(seq),), (now,))
            started = now if started < 0 else min(started, now)
            if now > started + self.limit:
                ended = True
                yield self._outcome(key, "ABORT", "TIME_LIMIT", steps, calls, started + self.limit)
                continue
            steps, calls = steps + 1, calls + (tool is not None and tool == tool and tool != "")
            if steps > self.most[0] or calls > self.most[1]:
                ended = True
                yield self._outcome(key, "ABORT", "BUDGET_EXCEEDED", steps, calls, now)
            elif node in ENDS:
                ended = True
                yield self._outcome(key, node, None, steps, calls, now)
        # An ended run is remembered for one limit more, so that stragglers don't start it anew.
        timer = self._timer(timer, started + self.limit * (2 if ended else 1))
        self.run.update((steps, calls, started, timer, ended))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        steps, calls, started, timer, ended = self.run.get()
        if expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        if ended:
            self.run.clear()
            self.seen.clear()
            return
        yield self._outcome(key, "ABORT", "TIME_LIMIT", steps, calls, started + self.limit)
        self.handle.registerTimer(started + 2 * self.limit)
        self.run.update((steps, calls, started, started + 2 * self.limit, True))

    def close(self) -> None:
        pass


def run_budgets(steps: DataFrame, budgets: dict[str, int] = BUDGETS, limit_seconds: float = 300, late: str = "10 minutes") -> DataFrame:
    """steps (run_id, seq, node, tool, at timestamp) as a stream -> one row a run, when it ends: run_id, status, reason, steps, tool_calls, at.

    A run ends with a node of ENDS, when a step exceeds its budgets (ABORT, BUDGET_EXCEEDED), or
    when event time passes its limit (ABORT, TIME_LIMIT), whether steps still come or not. A step
    that comes twice counts once; steps of one micro-batch count in event time; steps behind the
    watermark are dropped. State is cleared one limit after a run's end. Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass).
    """
    processor = _Budget(budgets["steps"], budgets["tool_calls"], int(limit_seconds * 1000))
    rows = steps.where("run_id IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL").select("run_id", "seq", "node", "tool", "at")
    return rows.withWatermark("at", late).groupBy("run_id").transformWithStateInPandas(processor, OUTCOME, "Append", "EventTime")
