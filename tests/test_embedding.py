"""Stored vocabularies and embedders of the caller's."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyproof.operators import embedding, retrieval
from tallyproof.sources import index_store


def letters():
    """Counts of a few characters, as a model's stand-in; a class of its own here, as workers don't import tests."""

    class Letters:
        def embed(self, texts):
            import numpy

            return numpy.array([[t.count(c) for c in "资产负债收入"] for t in texts.to_pylist()], float)

    return Letters()


def test_a_saved_vocabulary_gives_the_same_weights(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None)], "id int, t array<string>")
    model = embedding.fit_tfidf(docs, "id", F.col("t"))
    model.save(str(tmp_path / "v"))
    other = spark.createDataFrame([(7, ["a", "b", "new"]), (8, ["new"]), (9, None)], "id int, t array<string>")
    got = sorted(tuple(r) for r in embedding.Tfidf.load(spark, str(tmp_path / "v")).weights(other, F.col("t"), "id").collect())
    a, b = np.log(3 / 2) + 1, np.log(3 / 3) + 1
    assert [(i, t) for i, t, _ in got] == [(7, "a"), (7, "b")] and np.allclose([w for *_, w in got], np.array([a, b]) / np.hypot(a, b))


@pytest.mark.parametrize("block,group", [(7, 3), (8192, 4096)])
def test_blocked_products_equal_all_pairs(spark, block, group):
    rng = random.Random(4)
    vec = lambda d=5: [float(rng.randint(-3, 3)) for _ in range(d)]
    units = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), vec(rng.choice([5, 5, 5, 4]))) for i in range(200)] + [(900, "hot", None), (901, "hot", [1.0, None, 0.0, 0.0, 0.0]), (902, "hot", [float("nan")] * 5), (903, "hot", [0.0] * 5), (904, "hot", [])]
    asked = [(i, rng.choice(["hot", "a", "c", None]), vec()) for i in range(30)] + [(77, "hot", None)]
    schema = "id int, key string, vec array<double>"
    got = embedding.dense_top_k(spark.createDataFrame(asked, schema).withColumnRenamed("id", "question_id"), spark.createDataFrame(units, schema).withColumnRenamed("id", "unit"), 4, "key", block=block, group=group)
    want = []
    for q, key, x in asked:
        scored = [(round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6), u) for u, k, y in units[:200] if x and key is not None and k == key and len(y) == len(x) and np.linalg.norm(x) and np.linalg.norm(y)]
        want += [(q, u, s, n) for n, (s, u) in enumerate(sorted([z for z in scored if z[0] > 0], key=lambda z: (-z[0], z[1]))[:4], 1)]
    assert sorted((r["question_id"], r["unit"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)


def test_retrieve_takes_an_embedder(spark):
    rows = [("d", f"c{i}", x, "合并", 1, x, 0, i, ["1.00"]) for i, x in enumerate(("资产总计", "负债合计", "营业收入"))] + [("e", "c9", "资产总计", None, 1, "资产总计", 0, 0, ["1.00"])]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, label string, scope string, page int, text string, table_index int, row_index int, values array<string>")
    index = index_store.build(chunks) | {"dense": embedding.embed(chunks, "text", letters())}
    asked = spark.createDataFrame([("q", "d", "营业收入是多少")], "question_id string, doc_id string, question string")
    top = retrieval.retrieve(asked, index, 1, embedder=letters()).first()
    assert top.chunk_id == "c2" and "vector" in top.via
    assert [r.vec for r in embedding.embed(spark.createDataFrame([(None,), ("资资",)], "t string"), "t", letters()).orderBy("t").collect()] == [None, [2.0, 0.0, 0.0, 0.0, 0.0, 0.0]]
