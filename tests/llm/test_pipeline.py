"""The pipeline's stages against brute force on a small planted corpus, and the registry."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tallyproof.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("ta", "re", "mi", "no", "lu", "ke", "so", "pi")) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(30)) for i in range(3)]
    rows, labels, role = [], [], {}
    for i in range(600):
        t, kind = prose(rng.randrange(40, 90)), "clean"
        if i % 7 == 3:
            t, kind = " ".join(w + "%%%" for w in t.split()), "junk"
        elif i % 31 == 5:
            t, kind = f"{t} {items[i % 3][1]} {prose(5)}", "leak"
        elif i % 29 == 4:
            t, kind = f"{t} secret = {rng.randrange(10**9, 10**10)} {prose(3)}", "secret"
        elif i % 23 == 6 and rows:
            j = rng.choice([k for k, v in role.items() if v == "clean"])
            t, kind = rows[j][1], "copy"
        rows.append((i, t, "xx", f"s{min(i % 5, 2)}", len(t)))
        role[i] = kind
        if i % 2:
            labels.append((i, int(kind != "junk"), 0))
    rows.append((700, None, None, None, None))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, role


def test_stages_act_on_their_decisions(spark, corpus):
    path, rows, role = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    good = corpus_pipeline.keep_quality(spark, docs, path)
    kept = ids(good) - {700}
    assert kept == {i for i, v in role.items() if v != "junk"} and good.columns == docs.columns
    base = docs.where("doc_id <> 700")
    one = corpus_pipeline.drop_near_copies(spark, base, path)
    first = {}
    for i, t, *_ in rows[:-1]:
        first.setdefault(t, i)
    assert ids(one) == set(first.values()) and one.columns == docs.columns
    clean = corpus_pipeline.drop_leaks(spark, docs, path)
    assert ids(clean) == {i for i, v in role.items() if v != "leak"} | {700}
    safe = corpus_pipeline.redact_secrets(spark, docs, path)
    assert safe.count() == docs.count() and {r.doc_id for r in safe.where("text LIKE '%[SECRET]%'").collect()} == {i for i, v in role.items() if v == "secret"}
    assert safe.where("n_chars <> length(text)").count() == 0


def test_near_copies_stage_on_odd_rows(spark):
    rows = [(1, "a b c d e f", "x", "s", 11), (1, "a b c d e f", "x", "s", 11), (None, "a b c d e f", "x", "s", 11), (None, None, None, None, None), (2, "a b c d e f", "x", "s", 11), (3, "", "x", "s", 0)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, -1, 1, 3]
    rows = [(1, "a b c d e f", "y", "s", 11), (1, "a b c d e f", "x", None, 11), (1, "g h i j k l", "x", "s", 11), (2, "g h i j k l", "x", "s", 11), (4, "long " * 50_000, "x", "s", 1)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text[:11], r.lang) for r in got) == [(1, "a b c d e f", "x"), (1, "g h i j k l", "x"), (4, "long long l", "x")]


def test_near_copies_stage_drops_copies_from_080_on(spark):
    rng = random.Random(6)
    rows, stay = [], set()
    for i in range(0, 60, 3):
        w = [f"w{rng.random()}" for _ in range(100)]
        near, far = w[:], w[:]
        near[30] = near[60] = "x"  # 86 of 106 shingles, 0.81
        far[20] = far[40] = far[60] = "y"  # 81 of 111 shingles, 0.73
        for k, words in enumerate((w, near, far)):
            rows.append((i + k, " ".join(words), "x", "s", 1))
        stay |= {i, i + 2}
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r.doc_id for r in got} == stay


def test_run_mixes_what_is_left(spark, corpus):
    path, rows, role = corpus
    out = corpus_pipeline.run(spark, path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "source_mixing"]
    got = {(r.doc_id, r.copy_no) for r in out.select("doc_id", "copy_no").collect()}
    assert len(got) == out.count() and {c for _, c in got} <= {1, 2}
    left = {i for i, v in role.items() if v in ("clean", "secret", "copy")}
    assert {i for i, _ in got} <= left | {700} and not {i for i, v in role.items() if v in ("junk", "leak")} & {i for i, _ in got}
    words = out.withColumn("w", mixing.word_count())
    assert words.agg(F.sum("w")).first()[0] > 0


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    q = __spark_entry__.queries()
    for name in [n for n in q if n.startswith("op")] + ["pipeline"]:
        assert q[name](spark, path).count() == 0, name


def test_extra_columns_pass_the_stages(spark, corpus):
    path, rows, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("target", F.lit("t")).withColumn("row", F.lit("r")).withColumn("n", F.lit(2)).withColumn("copy_no", F.lit(9)).withColumn("others", F.lit("o"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.where("target <> 't' OR row <> 'r' OR n <> 2 OR others <> 'o' OR copy_no <> 9").isEmpty()
    mixed = corpus_pipeline.mix_sources(spark, docs, path)
    assert sorted(mixed.columns) == sorted(docs.columns) and mixed.where("target <> 't' OR copy_no NOT IN (1, 2)").isEmpty()


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
