"""The index as Parquet tables, partitioned by a hash bucket of the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators.pruned import impacts_of, index_of
from ..operators.retrieval import chunk_postings, numbers, tfidf
from ..session import cut

TABLES = ("chunks", "numbers", "postings", "vectors", "meta")
#: Tables of a pruned lexical search, which an index has if it was built so.
PRUNED = ("impacts", "terms", "blocks")


def build(chunks: DataFrame, hold: bool = False, pruned: bool = False) -> dict[str, DataFrame]:
    """All index tables of a chunk table; hold: each computed once, for an index that is used before it is written.

    pruned: with impacts (lengths and frequencies in them), terms and blocks, from which the
    lexical channel takes its best chunks without reading whole posting lists.
    """
    keep = cut if hold else lambda df: df
    chunks = keep(chunks.withColumn("label_form", normalize_text("label")))
    posts = keep(chunk_postings(chunks))
    counts = chunks.groupBy("scope").agg(F.count("*").alias("n")).select(F.concat(F.lit("chunks."), F.coalesce("scope", F.lit("none"))).alias("key"), F.col("n").cast("string").alias("value"))
    index = {"chunks": chunks, "numbers": keep(numbers(chunks)), "postings": posts, "vectors": keep(tfidf(posts)), "meta": counts}
    if pruned:
        index["impacts"] = keep(impacts_of(posts))
        index |= {name: keep(df) for name, df in index_of(index["impacts"]).items()}
    return index


#: Chunks in a bucket, by default: some tens of MB of text.
BUCKET_CHUNKS = 200_000


#: Chunks looked up by id are found by a filter in each file, as ids don't follow the order of rows.
BLOOM = {"parquet.bloom.filter.enabled#chunk_id": "true", "parquet.bloom.filter.expected.ndv#chunk_id": str(BUCKET_CHUNKS)}


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")


def write(index: dict[str, DataFrame], path: str, buckets: int | None = None) -> None:
    """Overwrite the index at `path`; rows of a document are together, sorted for min/max skipping.

    The number of buckets follows from the number of chunks unless it is given, and is kept
    beside the tables.
    """
    buckets = buckets or max(1, -(-index["chunks"].count() // BUCKET_CHUNKS))
    keys = {"chunks": ["label", "chunk_id"], "numbers": ["value", "chunk_id"], "postings": ["token", "chunk_id"], "vectors": ["token", "chunk_id"], "impacts": ["chunk_id", "token"], "terms": ["token"], "blocks": ["token", "part", "block"]}
    for name, df in index.items():
        if name in keys:
            df.withColumn("bucket", _bucket(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "doc_id", *keys[name]).write.mode("overwrite").options(**(BLOOM if "chunk_id" in df.columns else {})).partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    index["chunks"].sparkSession.range(buckets, buckets + 1).write.mode("overwrite").parquet(f"{path}/layout")


def load(spark: SparkSession, path: str, documents: DataFrame | None = None) -> dict[str, DataFrame]:
    """The index's tables; with documents (doc_id) only their rows, from the buckets that hold them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    held = {f.getPath().getName() for f in fs.listStatus(root)}
    found = {t: spark.read.parquet(f"{path}/{t}") for t in (*TABLES, *PRUNED) if t in held}
    if documents is not None:
        n = spark.read.parquet(f"{path}/layout").first()["id"]
        wanted = documents.select("doc_id").distinct().withColumn("bucket", _bucket(n))
        buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most as many as the index has
        found = {t: df if t == "meta" else df.where(F.col("bucket").isin(buckets)).join(wanted, ["bucket", "doc_id"], "left_semi") for t, df in found.items()}
    return {t: df.drop("bucket") for t, df in found.items()}


def scope_report(chunks: DataFrame) -> DataFrame:
    """Chunks per scope, without scope last: all null would mean that scopes can't be told apart."""
    return chunks.groupBy("scope").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last("scope"))


def lookup(index: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """Chunks by id, for a table of (chunk_id)."""
    return index["chunks"].join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
