"""Run traces: append-only Parquet tables; the last write of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS = "run_id string, question string, started_at timestamp, ended_at timestamp, route string, decision string, reason string, steps int, tool_calls int, written_at timestamp"
STEPS = "run_id string, seq int, node string, tool string, args string, ok boolean, detail string, source string, written_at timestamp"


def append(rows: DataFrame, path: str) -> None:
    """Append rows in their order: written_at is the write's time, written_seq the place in it."""
    rows.withColumn("written_at", F.current_timestamp()).withColumn("written_seq", F.monotonically_increasing_id()).write.mode("append").parquet(path)


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """One row per key, the last written (replace on conflict); on equal times the last of a write, else the row with the greatest hash."""
    ties = [F.desc("written_seq")] if "written_seq" in rows.columns else [F.desc(F.xxhash64(*rows.columns))]
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("written_at"), *ties))).where("n = 1").drop("n")


def runs(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """Runs, the latest started first; limit from 1 to 50."""
    return latest(spark.read.parquet(path), "run_id").orderBy(F.desc("started_at"), "run_id").limit(max(1, min(50, limit)))


def replay(steps: DataFrame) -> DataFrame:
    """run_id, text: a readable line per step, with its mark and at most 60 characters of detail."""
    mark = F.when(F.col("ok"), "✓").when(~F.col("ok"), "✗").otherwise("·")
    line = F.format_string("%02d %s %-12s %-20s %s", "seq", mark, F.coalesce("node", F.lit("")), F.coalesce("tool", F.lit("")), F.substring(F.coalesce("detail", F.lit("")), 1, 60))
    lines = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return steps.groupBy("run_id").agg(lines.alias("l")).select("run_id", F.array_join(F.transform("l", lambda x: F.rtrim(x["line"])), "\n").alias("text"))
