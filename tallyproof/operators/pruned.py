"""Lexical top-k over an impact-ordered index with block maxima: BM25 ranks without reading whole posting lists.

The index (by document, as everything here):

* terms: key, token, df, most (the token's greatest impact), parts (into how many lists it is dealt)
* blocks: key, token, part, block, most, postings: BLOCK units with their impacts, greatest first
* impacts: key, unit, token, impact: what a token adds to a unit's score, with idf and length in it

A search reads in two steps. The first blocks of the question's tokens give partial scores; the
best units by them are scored in full by their impacts, which are looked up by (unit, token), and the kth of
these is a score to beat. Then a token's block is read only if its greatest impact and
the greatest ones of the question's other tokens can reach that score, and only for tokens
without which it can't be reached. Units met so that can still reach it are scored in full, a row
a unit with its impacts, however many questions met it (see retrieval.best_units). All other steps are
joins and aggregations over many questions at once.

Lists of frequent tokens are dealt into parts by unit, so none is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import B, K1, best_units

#: Postings of a block, and of a part of a list at most (about).
BLOCK = 128
PART = 1 << 16
#: Times k units that are scored in full first, for the score to beat.
FIRST = 4
#: Scores are compared to so many decimals, so that the order of additions doesn't matter.
DIGITS = 6


def impacts_of(posts: DataFrame, key: str = "doc_id", unit: str = "chunk_id", length: DataFrame | None = None) -> DataFrame:
    """(key, unit, token, impact) of postings (key, unit, token, tf): the terms of Okapi BM25, whose idf is at least 1e-6.

    length: (key, unit, dl) of all units, where the postings are of some tokens only; else it is made.
    """
    length = posts.groupBy(key, unit).agg(F.sum("tf").alias("dl")) if length is None else length
    total = length.groupBy(key).agg(F.count("*").alias("n_units"), F.avg("dl").alias("avgdl"))
    terms = posts.groupBy(key, "token").agg(F.count("*").alias("df")).join(total, key)
    idf = F.greatest(F.log((F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    terms = terms.select(key, "token", idf.alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return posts.join(terms, [key, "token"]).join(length, [key, unit]).select(key, unit, "token", part.alias("impact"))


def index_of(impacts: DataFrame, key: str = "doc_id", unit: str = "chunk_id", block: int = BLOCK, part: int = PART) -> dict[str, DataFrame]:
    """terms and blocks of a written table of impacts."""
    terms = impacts.groupBy(key, "token").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
    terms = terms.withColumn("parts", F.ceil(F.col("df") / part).cast("int"))
    dealt = impacts.join(terms.select(key, "token", "parts"), [key, "token"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(unit), F.col("parts")).cast("int"))
    order = Window.partitionBy(key, "token", "part").orderBy(F.desc("impact"), unit)
    at = dealt.withColumn("block", F.floor((F.row_number().over(order) - 1) / block).cast("int"))
    postings = F.sort_array(F.collect_list(F.struct("impact", F.col(unit).alias("unit"))), asc=False)
    return {"terms": terms, "blocks": at.groupBy(key, "token", "part", "block").agg(F.max("impact").alias("most"), postings.alias("postings"))}


def _kth(scores: DataFrame, query: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score")))
    return scores.withColumn("r", rank).where(F.col("r") <= k).groupBy(query).agg(F.when(F.count("*") == k, F.min("score")).alias("beat"))


def _scored(met: DataFrame, asked: DataFrame, index: dict[str, DataFrame], key: str, unit: str, query: str) -> DataFrame:
    """(query, unit, score) in full of units met (query, key, unit); parts are added in the tokens' order."""
    wanted = met.join(asked, [query, key]).join(index["impacts"], [key, unit, "token"])
    parts = F.array_sort(F.collect_list(F.struct("token", "impact")))
    return wanted.groupBy(query, unit).agg(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["impact"]).alias("score"))


def candidates(asked: DataFrame, index: dict[str, DataFrame], k: int, key: str = "doc_id", query: str = "question_id", unit: str = "chunk_id") -> DataFrame:
    """Blocks that must be read: query, key, token, part, block, postings; the token's greatest impact (most), all of the query's (all),
    and the score to reach. asked: (query, key, token)."""
    asked = asked.select(query, key, "token").distinct()
    known = asked.join(index["terms"], [key, "token"])
    by_most = Window.partitionBy(query).orderBy("most", "token")
    known = known.select(query, key, "token", "most", F.sum("most").over(Window.partitionBy(query)).alias("all"), F.sum("most").over(by_most.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    first = known.select(query, key, "token").join(index["blocks"].where("block = 0"), [key, "token"])
    partial = first.select(query, key, F.explode("postings").alias("p")).groupBy(query, key, F.col("p.unit").alias(unit)).agg(F.sum("p.impact").alias("partial"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("partial"), unit))
    best = partial.withColumn("r", rank).where(F.col("r") <= FIRST * k).select(query, key, unit)
    beat = _kth(_scored(best, asked, index, key, unit, query), query, k)
    # A margin for rounding and for scores that are equal to DIGITS decimals.
    reach = F.coalesce(F.col("beat") - 2 * 10.0**-DIGITS, F.lit(float("-inf")))
    need = known.join(beat, query, "left").where(F.col("upto") >= reach)
    blocks = index["blocks"].withColumnRenamed("most", "block_most")
    return need.join(blocks, [key, "token"]).where(F.col("block_most") + F.col("all") - F.col("most") >= reach).select(query, key, "token", "part", "block", "postings", "most", "all", reach.alias("reach"))


def top_k(asked: DataFrame, index: dict[str, DataFrame], k: int, key: str = "doc_id", unit: str = "chunk_id", query: str = "question_id") -> DataFrame:
    """(query, unit, score, rank): the k best by BM25 of each query, compared to DIGITS decimals; ties go to the smaller unit.

    index: terms and blocks, see index_of(), and impacts. Tokens outside the index count
    nothing; a unit without any of the tokens isn't ranked, so a query may have fewer than k.
    """
    read = candidates(asked, index, k, key, query, unit)
    each = read.select(query, key, "most", "all", "reach", F.explode("postings").alias("p"))
    # What a unit's read postings leave open is at most the greatest impacts of the tokens it wasn't met by.
    met = each.groupBy(query, key, F.col("p.unit").alias(unit)).agg((F.sum("p.impact") - F.sum("most") + F.max("all")).alias("at_most"), F.max("reach").alias("reach"))
    met = met.where(F.col("at_most") >= F.col("reach")).select(key, unit).distinct()
    asked = asked.select(query, key, "token").distinct().withColumn("w", F.lit(1.0))
    # What is scored besides, by another question's meeting, has its full score too.
    held = index["impacts"].join(asked.select(key, "token").distinct(), [key, "token"], "left_semi").join(met, [key, unit], "left_semi")
    rows = held.groupBy(key, unit).agg(F.array_sort(F.collect_list(F.struct("token", F.col("impact").alias("x")))).alias("parts"))
    return best_units(asked, rows, k, key, unit, query)


def share_read(asked: DataFrame, index: dict[str, DataFrame], k: int, key: str = "doc_id", query: str = "question_id", unit: str = "chunk_id") -> DataFrame:
    """One row: postings of the queries' tokens, and how many of them the search reads (the first blocks too)."""
    terms = asked.select(query, key, "token").distinct().join(index["terms"], [key, "token"])
    first = terms.select(query, key, "token").join(index["blocks"].where("block = 0"), [key, "token"]).select(query, key, "token", "part", "block", "postings")
    read = candidates(asked, index, k, key, query, unit).drop("most", "all", "reach").unionByName(first).dropDuplicates([query, key, "token", "part", "block"])
    return terms.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).withColumn("one", F.lit(1)).join(read.agg(F.coalesce(F.sum(F.size("postings")), F.lit(0)).alias("read")).withColumn("one", F.lit(1)), "one").drop("one")
