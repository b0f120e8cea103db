"""Question banks: JSON lines with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "item_id string, track string, doc string, company string, period string, question string, question_type string, expected_outcome string, scope string, "
    "gold_value string, gold_unit string, gold_verdict string, formula string, refusal_reason string, expected_refusal_code string, "
    "gold_pages array<int>, gold_evidence array<string>, gold_operands map<string, string>, difficulty string, notes string, source string"
)


#: Lines that hold no item.
_SKIPPED = r"^\s*(?:#|$)"


def _parsed(line: Column) -> Column:
    return F.from_json(line, f"{SCHEMA}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Items of a bank; blank lines and lines that begin with # are skipped, a line that isn't JSON is an error that names its file and what it holds.

    bad_lines() gives the numbers of all such lines.
    """
    # The parser sees null for skipped lines, whatever the order in which filters are applied.
    item = F.when(~F.col("value").rlike(_SKIPPED), F.col("value"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), _parsed(item).alias("i"))
    problem = F.concat(F.lit("not an item of a bank: "), "file", F.lit(": "), F.substring("i.broken", 1, 80))
    checked = F.when(F.col("i.broken").isNull(), F.col("i")).otherwise(F.raise_error(problem))
    return lines.where("i IS NOT NULL").select(checked.alias("i")).select("i.*").drop("broken")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): lines of a bank that aren't JSON objects, by number from 1; each file is read as one text."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "text"))
    lines = texts.where(~F.col("text").rlike(_SKIPPED)).withColumn("i", _parsed(F.col("text")))
    return lines.where("i.broken IS NOT NULL").select("file", (F.col("at") + 1).alias("line"), "text")


def write_bank(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)


def bank_stats(items: DataFrame) -> DataFrame:
    """Counts by type, scope, document and difficulty in one pass: (dimension, value, n), and the formulas covered."""
    sets = items.groupingSets([["question_type"], ["scope"], ["doc"], ["difficulty"], ["formula"]], "question_type", "scope", "doc", "difficulty", "formula").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    names = {0b01111: "question_type", 0b10111: "scope", 0b11011: "doc", 0b11101: "difficulty", 0b11110: "formula"}
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g, c in names.items():
        dimension, value = F.when(F.col("g") == g, c).otherwise(dimension), F.when(F.col("g") == g, F.col(c)).otherwise(value)
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n").where("NOT (dimension = 'formula' AND value IS NULL)")
