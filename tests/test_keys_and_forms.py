"""Document keys, compatibility forms, ties, and searches without an index."""

import unicodedata

import pytest

from pyspark.sql import functions as F

from tallyproof.functions import text
from tallyproof.operators import evidence, geometry, retrieval, tables
from tallyproof.plans import evaluation, tools
from tallyproof.sources import index_store, trace

CHUNK = "doc_id string, chunk_id string, label string, scope string, page int, text string, table_index int, row_index int"


def test_forms_of_several_code_points(spark):
    texts = ["…½㎡㈱ ﬁ", "plain 1,234", "ＡＢ：㌀", "", None, "é É — “q”"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(text.normalize_text("t").alias("n")).collect()]
    plain = str.maketrans({"—": "-", "“": '"', "”": '"'})
    assert got == ["".join(unicodedata.normalize("NFKC", t or "").split()).translate(plain) for t in texts]


def test_words_of_two_documents_never_make_one_run(spark):
    words = [("a", 1, 0.0, 0.0, 5.0, 1.0, "net", 0, 0), ("b", 1, 6.0, 0.0, 9.0, 1.0, "profit", 0, 0), ("c", 1, 0.0, 0.0, 5.0, 1.0, "net", 0, 0), ("c", 1, 6.0, 0.0, 9.0, 1.0, "profit", 0, 0), ("c", 1, 0.0, 9.0, 5.0, 10.0, "net", 1, 0)]
    table = spark.createDataFrame(words, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, block int, line int")
    asked = spark.createDataFrame([("t", d, 1, "netprofit") for d in "abc"] + [("u", "c", 1, "net"), ("v", "c", 1, "profit")], "target_id string, doc_id string, page int, target string")
    assert [(r.target_id, r.doc_id) for r in geometry.find_text(asked.where("target_id = 't'"), table).collect()] == [("t", "c")]
    assert {r.target_id for r in geometry.find_text(asked, table, unique=True).collect()} == {"t", "v"}


def test_needles_are_found_whatever_their_length(spark):
    texts = spark.createDataFrame([(1, "abcdefghijkl"), (2, "xyz"), (3, ""), (4, None), (5, "a" * 50)], "text_id int, plain string")
    needles = ["a", "abc", "defghijkl", "defghijkX", "z", "", "a" * 20, "yz"]
    found = evidence.containing(texts, "plain", spark.createDataFrame([(n,) for n in needles], "needle string"), "needle", most=12)
    want = {(i, n) for i, t in ((1, "abcdefghijkl"), (2, "xyz"), (5, "a" * 50)) for n in needles if n and n in t}
    assert {(r.text_id, r.needle) for r in found.collect()} == want
    assert evidence.containing(texts, "plain", spark.createDataFrame([], "needle string"), "needle").count() == 0


def test_needles_of_any_characters_and_one_beginning(spark):
    head = "the same sentence begins each of them, "
    needles = ["a\x01b", "\x00", "\x02\x01", *[f"{head}number {i}." for i in range(60)], head]
    texts = [(i, f"x {head}number {i}. y" + ("a\x01b" if i == 3 else "\x00" if i == 4 else "")) for i in range(70)]
    for most in (1 << 20, 300):
        found = evidence.containing(spark.createDataFrame(texts, "text_id int, plain string"), "plain", spark.createDataFrame([(n,) for n in needles], "needle string"), "needle", most=most)
        assert sorted((r.text_id, r.needle) for r in found.collect()) == sorted((i, n) for i, t in texts for n in needles if n in t)


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_needles_of_a_document_meet_its_own_texts(spark, most):
    """200 documents with one common sentence: as many pairs as hits, and hot or null keys."""
    common = "one common sentence"
    texts = [(f"d{i}" if i else None, p, f"{common} of {i} {'q' * p}") for i in range(200) for p in range(2)]
    needles = [(f"d{i}" if i else None, k, n) for i in range(200) for k, n in enumerate((common, f"of {i} q"))] + [("d5", 7 + k, f"sentence of 5{' q' * (k == 1)}{k if k > 1 else ''}") for k in range(40)]
    t, n = spark.createDataFrame(texts, "doc_id string, page int, plain string"), spark.createDataFrame(needles, "doc_id string, k int, needle string")
    got = evidence.containing(t, "plain", n, "needle", by=["doc_id"], most=most)
    assert sorted((r.doc_id, r.page, r.k) for r in got.collect()) == sorted((d, p, k) for d, p, x in texts for e, k, y in needles if d is not None and d == e and y in x)
    scanned = [r for r in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in r]
    assert len(scanned) <= 1 + sum(len(y) for _, _, y in {(d, 0, y) for d, _, y in needles}) // most


def test_tools_without_an_index_and_without_formulas(spark):
    chunks = spark.createDataFrame([("d", "c1", "存货", "合并", 2, "存货 | 1", 0, 0), ("d", "c2", "存货跌价", None, 2, "x", 0, 1), ("e", "c3", "存货", None, 2, "x", 0, 0)], CHUNK)
    asked = spark.createDataFrame([("r1", "d", "存货"), ("r2", "d", "商誉"), ("r3", "d", "")], "request_id string, doc_id string, query string")
    got = sorted((r.request_id, r.chunk_id, r.error, r.degraded) for r in tools.search_statement(asked, {"chunks": chunks}).collect())
    assert got == [("r1", "c1", None, "no_index"), ("r1", "c2", None, "no_index"), ("r2", None, "NO_RECALL", None), ("r3", None, "NO_RECALL", None)]
    assert [r.error for r in tools.list_formulas(spark, "nothing").collect()] == ["NO_FORMULA"]
    assert {r.error for r in tools.list_formulas(spark).collect()} == {None} and tools.list_formulas(spark).count() == 8
    for name in tools.SPECS:
        schema = tools.tool_schema(name)
        assert callable(getattr(tools, name)) and set(schema["required"]) <= set(schema["properties"])


def test_the_last_written_row_counts_on_equal_times(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1, "first"), ("r", 1, "second"), ("s", 1, "only")], "run_id string, seq int, detail string").coalesce(1)
    trace.append(rows, str(tmp_path))
    got = {r.run_id: r.detail for r in trace.latest(spark.read.parquet(str(tmp_path)), "run_id", "seq").collect()}
    assert got == {"r": "second", "s": "only"}


def test_statistics_without_one_task_for_all(spark):
    rows = [(f"i{k}", "ANSWER", True, None, "ANSWER", 1, float(k), 5, k % 2 == 0) for k in range(11)]
    df = spark.createDataFrame(rows, "item_id string, expected_outcome string, passed boolean, failure string, decision string, tool_calls int, latency_ms double, tokens bigint, evidence_recalled boolean")
    r = evaluation.eval_stats(df).first()
    assert (r.p50_ms, r.p95_ms, r.evidence_recalled, r.total) == (5.0, 10.0, 6, 11)
    calls = spark.createDataFrame([("a", 1, 10), ("a", 2, 25), ("b", 1, 7)], "run_id string, ord int, total_tokens bigint")
    assert sorted((r.run_id, r.tokens) for r in evaluation.usage_per_question(calls).collect()) == [("a", 10), ("a", 15), ("b", 7)]
    assert evaluation.eval_stats(df.where(F.lit(False))).first().p50_ms == 0.0


def test_an_index_is_read_by_the_buckets_of_its_documents(spark, tmp_path):
    page = "<!-- page 1 of 1 -->\n## 合并资产负债表\n| 项目 | 附注 | 2024年12月31日 | 2023年12月31日 |\n| --- | --- | --- | --- |\n| 存货 | 1 | 1,234.00 | 99.00 |\n| 货币资金 | 1 | 5.00 | 6.00 |\n"
    docs = spark.createDataFrame([(f"d{i}", page) for i in range(12)], "doc_id string, text string")
    built = index_store.build(tables.build_chunks(docs))
    index_store.write(built, str(tmp_path), buckets=5)
    whole, some = index_store.load(spark, str(tmp_path)), index_store.load(spark, str(tmp_path), docs.where("doc_id IN ('d3', 'd7')"))
    assert whole["chunks"].count() == 24 and {r.doc_id for r in some["chunks"].collect()} == {"d3", "d7"} and "bucket" not in some["chunks"].columns
    assert "PartitionFilters: [bucket" in some["chunks"]._jdf.queryExecution().toString()
    asked = spark.createDataFrame([("q", "d3", "2024年存货是多少")], "question_id string, doc_id string, question string")
    hits = [sorted((r.chunk_id, round(r.score, 9), r.rank) for r in retrieval.retrieve(asked, i).collect()) for i in (built, whole, some)]
    assert hits[0] == hits[1] == hits[2] and hits[0]
