"""The training-data pipeline: documents in, a weighted mix of clean documents out.

Each stage works on all that its predecessor kept and acts on its decisions. Rows keep all
their columns; the last stage adds `copy_no` (1 up to the times a document is taken).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyproof.llm import decontam, mixing, quality, secret_scan
from tallyproof.llm.minhash import near_duplicates
from tallyproof.llm.store import Store


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on this stage's rows and their labels."""
    model = quality.fit_on_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Copies have a Jaccard similarity of 0.8 or more; groups of 3 minhashes miss a link at 0.8
    with a probability of 9e-5.
    Rows that share a doc_id are one document: of those with one text one row stays (the first
    by its other columns), of different texts each. Rows with a null doc_id are in no group and stay.
    """
    kept = near_duplicates(docs, threshold=80, group=3).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")]))
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("others"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", others.alias("others")).join(kept, "doc_id", "left_semi")
    rows = rows.select("row", first.alias("n")).where("n = 1").select("row.*")
    return rows.union(docs.where("doc_id IS NULL").select(rows.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or edited, go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark and n_chars counted anew."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its draw say, as rows numbered by copy_no (it replaces a column of that name)."""
    per_source = Store(spark).keep(mixing.rates(docs.select("source", mixing.word_count().alias("size"))))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "copy_no"]).alias("row"), "doc_id", "source")
    taken = mixing.mix(rows, per_source).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no")).select("row.*", "copy_no")


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
]

#: Not expressible in SQL (a trained classifier, alignment); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again."""
    store = Store(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir))
    return docs
