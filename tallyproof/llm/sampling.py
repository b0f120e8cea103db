"""Bounded, repeatable samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def sample(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """At most `size` rows, the first by a hash of `keys` (the same rows on every run)."""
    return rows.orderBy(F.xxhash64(*keys), *keys).limit(size)


def sample_evenly(rows: DataFrame, size: int, by: str, key: str) -> DataFrame:
    """At most `size` distinct (key, by), evenly over the first `size` values of `by`: of each the first by a hash of the key, in turns.

    Hashes with more leading zeros come first, so counts of ids by (by, leading zeros) tell how
    many zeros the first `size` ids of a value have; only such rows are ranked, some 2 * size of
    a value, however many rows it has.
    """
    h = F.shiftrightunsigned(F.xxhash64(key), 1)
    each = rows.select(key, by, h.alias("h"), (63 - F.length(F.bin(h))).alias("zeros"))
    counts = each.groupBy(by, "zeros").agg(F.count_distinct(key).alias("n"))
    from_top = Window.partitionBy(by).orderBy(F.desc("zeros"))
    least = F.max(F.when(F.col("reached") >= size, F.col("zeros")))
    cuts = counts.withColumn("reached", F.sum("n").over(from_top)).groupBy(F.col(by).alias("value")).agg(F.coalesce(least, F.lit(0)).alias("least"))
    cuts = cuts.orderBy(F.xxhash64("value"), "value").limit(size)  # so it can be broadcast
    first = each.join(F.broadcast(cuts), F.col(by) == F.col("value")).where("zeros >= least").select(key, by, "h").distinct()
    turn = F.row_number().over(Window.partitionBy(by).orderBy("h", key))
    return first.withColumn("turn", turn).where(F.col("turn") <= size).orderBy("turn", "h", key, by).limit(size).select(key, by)


def with_text(docs: DataFrame, chosen: DataFrame, *keys: str) -> DataFrame:
    """chosen with the text of its keys; of rows that share them, the text with the least hash.

    `chosen` is bounded by a sample's size, so it is broadcast; docs isn't shuffled, and no
    more rows come out than `chosen` has.
    """
    found = docs.select(*keys, "text").join(F.broadcast(chosen), list(keys))
    return found.groupBy(*chosen.columns).agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("t")).select(*chosen.columns, "t.text")
