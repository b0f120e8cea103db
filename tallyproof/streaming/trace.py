"""The run trace as a stream: appended steps, rolling counts with a watermark, and a token bucket."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_trace(steps: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of steps to a Parquet trace, all that is there, then stop."""
    return steps.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def step_counts(steps: DataFrame, at: str = "at", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Steps and failures per node and tumbling window; rows later than the watermark are dropped."""
    return steps.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "node").agg(F.count("*").alias("steps"), F.count_if(~F.col("ok")).alias("failed")).select("w.start", "w.end", "node", "steps", "failed")


def token_bucket(requests: DataFrame, rate: float = 5.0, burst: float = 5.0) -> DataFrame:
    """requests (client, at timestamp) -> client, at, admitted, tokens: a bucket per client that refills with event time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        tokens, last = state.get if state.exists else (burst, None)
        for pdf in frames:
            rows = []
            for at in sorted(pdf["at"]):
                now = at.timestamp()
                if last is not None:
                    tokens = min(burst, tokens + max(0.0, now - last) * rate)
                last = now if last is None else max(last, now)
                admitted = tokens >= 1
                tokens -= 1.0 if admitted else 0.0
                rows.append((key[0], at, admitted, tokens))
            state.update((tokens, last))
            yield pd.DataFrame(rows, columns=["client", "at", "admitted", "tokens"])

    return requests.groupBy("client").applyInPandasWithState(run, "client string, at timestamp, admitted boolean, tokens double", "tokens double, last double", "append", "NoTimeout")
