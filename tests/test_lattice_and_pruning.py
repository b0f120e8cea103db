"""Word lattices against all segmentations, and pruned top-k against full scores."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tallyproof.functions import lattice
from tallyproof.functions.lexicon import FINANCIAL_TERMS
from tallyproof.operators import pruned, retrieval


def cuts(text):
    for marks in product((0, 1), repeat=max(len(text) - 1, 0)):
        out, start = [], 0
        for i, m in enumerate(marks, 1):
            if m:
                out.append(text[start:i])
                start = i
        yield out + [text[start:]]


@pytest.mark.parametrize("seed", range(6))
def test_path_is_the_best_of_all_segmentations(seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(14)}
    known = lattice.Lattice(counts)
    cost = lambda words: sum(known.costs.get(w, known.unknown if len(w) == 1 else math.inf) for w in words)
    for _ in range(40):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 11)))
        best = min(cuts(text), key=lambda ws: (cost(ws), [-len(w) for w in ws]))
        assert known.path(text) == best, text


def test_financial_terms_stay_whole_and_other_text_is_cut(spark):
    texts = ["公司资产的构成", "资产合计与构成", "构成如下", "总资产", "净资产增加", "资产减少", "人员构成变化", "的构成说明", "资产", "构成", "资产折旧"]
    words = lattice.with_vocabulary(lattice.corpus_words(spark.createDataFrame([(t,) for t in texts], "text string"), "text", least=3))
    known = lattice.lattice_of(words)
    asked = ["营业收入", "营业总收入", "2024年营业收入是多少?", "手续费及佣金收入", "资产的构成", "", None, "，。 !", "ROE为12.5%"]
    got = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, text string").select("i", lattice.tokenize_by("text", known).alias("t")).orderBy("i").collect()]
    assert got == [["营业收入"], ["营业总收入"], ["2024", "年", "营业收入"], ["手续费及佣金收入"], ["资产", "构成"], [], [], [], ["ROE", "12", "5"]]
    assert all(known.path(t) == [t] for t in FINANCIAL_TERMS)


def test_words_of_the_corpus_are_frequent_and_free(spark):
    rows = [("x资产y", ), ("固定资产合计",), ("无形资产减值",), ("无形资产合计",), ("固定资产减值",), (None,), ("",), ("资",)]
    got = {r["word"]: r["n"] for r in lattice.corpus_words(spark.createDataFrame(rows, "text string"), "text", least=2).collect()}
    assert got["资产"] == 5 and "固定" not in got and "定资" not in got and "产合" not in got
    assert lattice.corpus_words(spark.createDataFrame([], "text string"), "text").count() == 0


def test_too_many_words_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        lattice.lattice_of(spark.range(9).select(F.col("id").cast("string").alias("word"), F.lit(1).alias("n")))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"d{i % 2}", f"u{i:04d}", tuple(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 40)))) for i in range(900)]
    rows += [("d0", "same1", ("w1", "w2")), ("d0", "same2", ("w1", "w2"))]
    asked = [(q, f"d{q % 2}", w) for q in range(30) for w in rng.sample(words, rng.randint(1, 6)) + ["absent"]] + [(99, "d0", "absent"), (98, "none", "w1")]
    posts = retrieval.postings(spark.createDataFrame(rows, "doc_id string, chunk_id string, t array<string>"), "doc_id", "chunk_id", F.col("t"))
    return posts.persist(), spark.createDataFrame(asked, "question_id int, doc_id string, token string")


@pytest.mark.parametrize("block,part,k", [(4, 1 << 16, 3), (8, 50, 5), (1, 7, 1), (128, 1 << 16, 1000)])
def test_pruned_ranks_equal_full_ones(spark, corpus, block, part, k):
    posts, asked = corpus
    impacts = pruned.impacts_of(posts).persist()
    index = pruned.index_of(impacts, block=block, part=part) | {"impacts": impacts}
    rank = lambda rows: sorted(((r["question_id"], r["chunk_id"], round(r["score"], 6)) for r in rows), key=lambda r: (r[0], -r[2], r[1]))
    full = rank(retrieval.bm25(asked, posts).collect())
    want = [r for i, r in enumerate(full) if sum(x[0] == r[0] for x in full[:i]) < k]
    got = rank(pruned.top_k(asked, index, k).collect())
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


def test_pruning_reads_less(spark):
    """Long lists whose impacts differ: most blocks can't reach the kth score."""
    rng = random.Random(1)
    rows = [("d", f"u{i:05d}", ["common"] * (1 + 9 * (i % 97 == 0)) + ["other"] * (i % 3 == 0) + [f"x{rng.randint(0, 9)}" for _ in range(1 + i % 13)]) for i in range(4000)]
    posts = retrieval.postings(spark.createDataFrame(rows, "doc_id string, chunk_id string, t array<string>"), "doc_id", "chunk_id", F.col("t"))
    impacts = pruned.impacts_of(posts).persist()
    index = {t: df.persist() for t, df in pruned.index_of(impacts, block=32).items()} | {"impacts": impacts}
    asked = spark.createDataFrame([(1, "d", "other"), (2, "d", "x3")], "question_id int, doc_id string, token string")
    share = pruned.share_read(asked, index, 5).first()
    assert share["postings"] > 1500 and share["read"] < share["postings"] / 3


def test_the_lexical_channel_of_a_pruned_index(spark, tmp_path):
    """Written, loaded for some documents, and searched: the same chunks as from postings; lookups by id have a filter to use."""
    from tallyproof.sources import index_store

    rng = random.Random(2)
    words = ["存货", "资产", "合同负债", "净利润", "应收账款", "商誉", "毛利率"]
    rows = [(f"d{i % 3}", f"c{i:03d}", w, None, 1, " ".join(rng.choices(words, k=4)), 0, i, ["1.00"]) for i in range(90) for w in [rng.choice(words)]]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, label string, scope string, page int, text string, table_index int, row_index int, values array<string>")
    index_store.write(index_store.build(chunks, pruned=True), str(tmp_path / "i"), 2)
    index = index_store.load(spark, str(tmp_path / "i"), spark.createDataFrame([("d0",), ("d1",)], "doc_id string"))
    assert set(index_store.PRUNED) <= set(index) and index["impacts"].select("doc_id").distinct().count() == 2
    asked = spark.createDataFrame([(f"q{i}", f"d{i % 3}", "".join(rng.sample(words, 2)) + "是多少") for i in range(12)], "question_id string, doc_id string, question string")
    plain = lambda df: sorted((r.question_id, r.rank, r.chunk_id) for r in df.collect())
    got = plain(retrieval.lexical_channel(asked, index["postings"], 4, index))
    assert got == plain(retrieval.lexical_channel(asked, index["postings"], 4)) and len(got) >= 24
    assert sorted(r.chunk_id for r in index_store.lookup(index, spark.createDataFrame([("c004",), ("c002",)], "chunk_id string")).collect()) == ["c004"]


@pytest.mark.parametrize("cells,asked_at_once,k", [(1 << 20, 1 << 20, 3), (50, 1 << 20, 5), (300, 40, 1), (1 << 20, 1 << 20, 1000)])
def test_best_units_equal_full_scores(spark, corpus, monkeypatch, cells, asked_at_once, k):
    """By steps and blocks of any size: the ranks of joins over all pairs."""
    posts, asked = corpus
    monkeypatch.setattr(retrieval, "CELLS", cells)
    monkeypatch.setattr(retrieval, "ASKED", asked_at_once)
    rows = posts.groupBy("doc_id", "chunk_id").agg(F.sum("tf").alias("dl"), F.array_sort(F.collect_list(F.struct("token", "tf"))).alias("parts"))
    rank = lambda rows: sorted(((r["question_id"], r["chunk_id"], round(r["score"], 6)) for r in rows), key=lambda r: (r[0], -r[2], r[1]))
    full = rank(retrieval.bm25(asked, posts).withColumn("score", F.round("score", 6)).collect())
    want = [r for i, r in enumerate(full) if sum(x[0] == r[0] for x in full[:i]) < k]
    assert rank(retrieval.best_units(*retrieval.bm25_parts(rows, asked), k).collect()) == want


def test_rows_of_units_and_their_cosines(spark):
    """Rows of one unit are one text, texts without tokens are none, copies tie by id; lengths and norms count tokens that nobody asks."""
    texts = [("d", "a", "x y y z"), ("d", "b", "x"), ("d", "b", "y q"), ("d", "c", ""), ("d", "e", None), ("d", "f", "x y y z"), (None, "g", "x"), ("e", "h", "x x")]
    units = spark.createDataFrame(texts, "doc_id string, chunk_id string, text string")
    words = F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1))
    asked = spark.createDataFrame([(1, "d", "y", 2), (1, "d", "x", 1), (2, "e", "x", 1), (3, "e", "none", 1)], "question_id int, doc_id string, token string, tf int")
    rows = {(r.doc_id, r.chunk_id): (r.dl, [(p.token, p.tf) for p in r.parts]) for r in retrieval.unit_rows(units, asked, words).collect()}
    assert rows["d", "b"] == (3, [("x", 1), ("y", 1)]) and rows["d", "a"] == (4, [("x", 1), ("y", 2)]) and ("d", "c") not in rows and ("d", "e") not in rows
    got = {(r.question_id, r.chunk_id): (round(r.score, 6), r["rank"]) for r in retrieval.best_units(*retrieval.cosine_parts(units, asked, words), 9).collect()}
    full = {(r.question_id, r.chunk_id): round(r.score, 6) for r in retrieval.cosine(asked, retrieval.postings(units, "doc_id", "chunk_id", words)).collect()}
    assert {k: v[0] for k, v in got.items()} == full and [got[1, c][1] for c in "afb"] == [1, 2, 3] and set(got) == {(1, "a"), (1, "b"), (1, "f"), (2, "h")}


def test_the_index_of_q49_holds_what_is_asked(spark, monkeypatch):
    """And its last step scores each unit once, not once a question and token."""
    from tallyproof import queries

    made, scored = [], []
    index_of, full = pruned.index_of, pruned._scored
    monkeypatch.setattr(pruned, "index_of", lambda impacts: made.append(impacts) or index_of(impacts))
    monkeypatch.setattr(pruned, "_scored", lambda met, *a: scored.append(met) or full(met, *a))
    assert queries.QUERIES["q49_pruned_top_k"](spark, "/root/testdata/sf0.001").count() > 0
    known = {r.token for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("token")).collect()}
    assert {r.token for r in made[0].select("token").distinct().collect()} <= known and len(scored) == 1
