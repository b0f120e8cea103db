"""Mixing sources to target weights by repetition rates.

Words are counted per source (a partial aggregation, so a source with a third of all rows
is no problem), targets follow from the weights, and each document is taken
floor(rate) times, plus once more where a hash-seeded draw falls below the fraction.

Targets: with total budget T = share * all words, source s gets min(cap_s, level * w_s);
the level that spends T is the largest (T - caps before s) / (weights from s on) over the
sources in order of cap_s / w_s. This is where resharing the excess by weight ends.

Draws: each document is taken floor(rate) times, and once more with a probability equal to
the fraction: if a uniform number from MD5 of its doc_id and the seed falls below it. So a
source's words taken differ from its target by chance, the less the more documents it has;
reruns agree.

Nulls and ties: null text has size 0; a null source is a source of its own, ordered last;
a null doc_id draws like the empty string; repeated rows draw alike; a source without
words has target 0. An empty table gives no rows. Other columns pass through mix(), but for
those that it returns itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)
SEED = 0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """A number of 0 to 2**32 - 1 from the document's id."""
    md5 = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("bigint")


def targets(sizes: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target). One row a source; sorted as one small table."""
    w = F.array(*map(F.lit, weights))[((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)).cast("int")]
    t = sizes.withColumn("w", w.cast("double")).withColumn("cap", (F.col("source_size") * cap).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_on = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("level", (budget - before) / weight_on)
    return t.select("source", "source_size", F.least("cap", F.col("w") * F.max("level").over(everything)).alias("target"))


#: Rows of a per-source table up to which it is sent to every task; a larger one is joined by key.
BROADCAST_SOURCES = 100_000


def _small(per_source: DataFrame) -> DataFrame:
    """The table marked for broadcast if it is small enough (it is counted), else as it is."""
    return F.broadcast(per_source) if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else per_source


def rates(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source of docs (source, size): source, source_size, target, rate, and as edge the draw below which one more copy is taken."""
    per = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights)
    per = per.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    return per.withColumn("edge", (F.col("rate") - F.floor("rate")) * F.lit(4294967296.0))


def mix(docs: DataFrame, per_source: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, ...) with source_size, target and copies (times it is taken); per_source: a written table of rates()."""
    per = _small(per_source.select(F.struct("*").alias("mix_rate")))
    rows = docs.select(F.struct("*").alias("mix_row"), draw(seed=seed).alias("mix_draw"))
    joined = rows.join(per, F.col("mix_row.source").eqNullSafe(F.col("mix_rate.source")))
    copies = F.floor("mix_rate.rate") + F.when(F.col("mix_draw") < F.col("mix_rate.edge"), 1).otherwise(0)
    made = {"source_size": F.col("mix_rate.source_size"), "target": F.col("mix_rate.target"), "copies": copies.cast("int")}
    return joined.select(*[F.col("mix_row")[c].alias(c) for c in docs.columns if c not in made], *[v.alias(k) for k, v in made.items()])
