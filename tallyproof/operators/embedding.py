"""Embedders: a TF-IDF vocabulary that is fitted, stored and applied to other texts, and dense vectors from any model.

An embedder is any object with `embed(texts: pa.Array) -> np.ndarray`, one row of floats a text;
it is sent to the tasks, where it sees Arrow batches. Its vectors are compared by matrix
products over blocks: the vectors of a key are dealt into blocks, its queries go to each of
them in groups, and only the best k of a block leave it, so no task holds a hot key.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: pa.Array) -> np.ndarray: ...


@dataclass
class Tfidf:
    """A fitted vocabulary: terms (token, idf)."""

    terms: DataFrame

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Tfidf:
        return Tfidf(spark.read.parquet(path))

    def weights(self, units: DataFrame, tokens: Column, *keys: str) -> DataFrame:
        """(keys…, token, w) of other texts: tf * idf, L2-normalised; tokens outside the vocabulary don't count."""
        counts = units.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("tf"))
        weighted = counts.join(self.terms, "token").withColumn("w", F.col("tf") * F.col("idf"))
        norm = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return weighted.join(norm, list(keys)).select(*keys, "token", (F.col("w") / F.col("norm")).alias("w"))


def fit_tfidf(units: DataFrame, unit: str, tokens: Column) -> Tfidf:
    """idf = ln((N + 1) / (df + 1)) + 1 over units; N counts those with a token."""
    posts = units.select(F.col(unit).alias("u"), F.explode(F.array_distinct(tokens)).alias("token")).distinct()
    n = posts.select("u").distinct().count()
    return Tfidf(posts.groupBy("token").agg(F.count("*").alias("df")).select("token", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf")))


def sparse_scores(queries: DataFrame, vectors: DataFrame, query: str = "question_id", unit: str = "unit") -> DataFrame:
    """(query, unit, score > 0) of weights (query, token, w) and (unit, token, w): an inner product by tokens."""
    q = queries.select(query, "token", F.col("w").alias("qw"))
    return q.join(vectors, "token").groupBy(query, unit).agg(F.sum(F.col("qw") * F.col("w")).alias("score")).where("score > 0")


def embed(rows: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """rows with `vec` (array<double>) of their texts, null for a null text; the embedder sees Arrow batches in tasks."""

    def run(column: pa.Array) -> pa.Array:
        known = column.drop_null()
        found = np.asarray(embedder.embed(known), float).reshape(len(known), -1) if len(known) else np.zeros((0, 0))
        given = iter(found.tolist())
        return pa.array([next(given) if ok else None for ok in column.is_valid().to_pylist()], pa.list_(pa.float64()))

    return rows.withColumn("vec", F.arrow_udf(run, "array<double>")(F.col(text)))


#: Vectors of a block, and queries that meet a block at once.
BLOCK = 8_192
GROUP = 4_096
#: Scores are compared to so many decimals.
DIGITS = 6


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, on: str = "doc_id", query: str = "question_id", unit: str = "unit", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query, unit, score, rank): the k best by cosine > 0 among vectors (unit, on, vec) of the query's (query, on, vec) key.

    Ties, to DIGITS decimals, go to the smaller unit. Vectors of another length than a query's
    meet nothing; nor do null ones, ones that hold null or non-finite numbers, zeros and null keys.
    """
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    unit_vec = F.transform("vec", lambda x: x.cast("double") / F.sqrt("l2"))
    size = F.size("vec").alias("dims")
    shaped = lambda df, id: df.where(ok & F.col(on).isNotNull()).select(F.col(id).alias("id"), on, "vec", length.alias("l2")).where("l2 > 0").select("id", on, size, unit_vec.alias("vec"))
    v, q = shaped(vectors, unit), shaped(queries, query)
    blocks = v.groupBy(on, "dims").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = q.groupBy(on, "dims").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
    greatest = lambda df, n: df.agg(F.max(n)).first()[0] or 1
    one = F.lit(1)
    if greatest(blocks, "blocks") == 1 and greatest(asked, "groups") == 1:  # no key needs dealing
        plan = None
    else:
        plan = blocks.join(asked, [on, "dims"])  # a row a key: how many blocks meet how many groups
    planned = lambda df: df.withColumns({"blocks": one, "groups": one}) if plan is None else df.join(plan, [on, "dims"])
    dealt = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    gid = ["on_hash", "dims", "block", "group_no"]
    key = F.col(on).alias("on_key")
    left = planned(q).withColumn("group_no", dealt("groups", 1)).withColumn("block", every("blocks")).select(F.xxhash64(on).alias("on_hash"), key, "dims", "block", "group_no", "id", "vec")
    right = planned(v).withColumn("block", dealt("blocks", 2)).withColumn("group_no", every("groups")).select(F.xxhash64(on).alias("on_hash"), key, "dims", "block", "group_no", "id", "vec")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        for one in set(a["on_key"].to_pylist()) if a.num_rows and b.num_rows else ():  # one key, but for equal hashes
            x, y = (t.filter(pc.equal(t["on_key"], one)) for t in (a, b))
            if not x.num_rows or not y.num_rows:
                continue
            dims = x["dims"][0].as_py()
            m = lambda t: t["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
            scores = m(x) @ m(y).T
            n = scores.shape[1]
            least = np.partition(scores, n - k, axis=1)[:, n - k] - 2 * 10.0**-DIGITS if n > k else np.full(len(scores), -2.0)
            rows, columns = np.nonzero((scores >= least[:, None]) & (scores > 0))
            found.append(pa.table([x["id"].take(pa.array(rows)), y["id"].take(pa.array(columns)), pa.array(scores[rows, columns])], names=[query, unit, "score"]))
        return pa.concat_tables(found) if found else pa.table([a["id"].slice(0, 0), b["id"].slice(0, 0), pa.array([], pa.float64())], names=[query, unit, "score"])

    types = dict(queries.dtypes)[query], dict(vectors.dtypes)[unit]
    best = left.groupBy(*gid).cogroup(right.groupBy(*gid)).applyInArrow(meet, f"{query} {types[0]}, {unit} {types[1]}, score double")
    best = best.withColumn("score", F.round("score", DIGITS)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), unit))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
