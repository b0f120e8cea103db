"""Intermediate tables in the shared folder, which cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


#: Folders of our own by application, where the session names none (local tests); the session's settings stay as they are.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; only where none is set (local tests), one of our own."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="tallyproof-"))
    return found.rstrip("/")


class Store:
    """Writes tables under one new folder of the shared directory."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.count = spark, f"{shared_dir(spark)}/tp-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and give the table read back."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame | None) -> None:
        """Delete the files of a kept table that nothing lazy reads any more."""
        for path in {f.rsplit("/", 1)[0] for f in (df.inputFiles() if df is not None else [])}:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
