"""The session that the library is tested with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(name: str = "tallyproof", **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution; settings that are passed win."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df computed once, for what reads it several times: written to the checkpoint folder where there is one, else kept by Spark.

    What is read from it has a short plan of its own, and outlives executors.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()
