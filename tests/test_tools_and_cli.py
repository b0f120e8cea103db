"""Tools over request tables, statistics, the ablation and the command line."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyproof import cli
from tallyproof.operators import tables
from tallyproof.plans import evaluation, tools
from tallyproof.sources import bank, index_store
from test_tables_and_answers import ITEM, REPORT


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.createDataFrame([("m", REPORT)], "doc_id string, text string")
    chunks = tables.build_chunks(docs).cache()
    facts = spark.createDataFrame([("m", "贵州茅台酒股份有限公司", "元", [2023, 2024])], "doc_id string, company string, unit string, years array<int>")
    return chunks, facts, index_store.build(chunks)


def requests(spark, rows, schema):
    return spark.createDataFrame([(i, "m", *r) for i, r in enumerate(rows)], f"request_id int, doc_id string, {schema}")


def column(df, c):
    return [r[c] for r in df.orderBy("request_id").collect()]


def test_tools(spark, made):
    chunks, facts, index = made
    r = requests(spark, [("2019年货币资金",), ("五粮液货币资金",), ("2024年茅台货币资金",)], "question string")
    assert column(tools.check_constraints(r, facts), "error") == ["OUT_OF_DOCUMENT_PERIOD", "WRONG_DOCUMENT", None]
    found = tools.search_statement(requests(spark, [("资产总计",), ("火星",)], "query string"), index)
    assert found.where("request_id = 0 AND rank = 1").first().label == "资产总计" and found.where("request_id = 1").first().error == "NO_RECALL"
    r = requests(spark, [("货币资金", "合并", "current"), ("货币资金", None, "current"), ("货币资金", "母公司", "prior"), ("净利润", "母公司", "current"), ("没有", None, "current"), ("结算备付金", "合并", "current"), ("所有者权益合计", "合并", "current")], "label string, scope string, period string")
    got = tools.get_row_evidence(r, chunks)
    assert column(got, "error") == [None, "AMBIGUOUS_SCOPE", None, "SCOPE_NOT_AVAILABLE", "LABEL_NOT_FOUND", "VALUE_UNPARSED", None]
    assert column(got, "value")[2] == Decimal(2000) and column(got, "printed")[6] == "所有者权益（或股东权益）合计"
    r = requests(spark, [("资产总计", "合并", "298,944,579,918.70", "298944579918.70"), ("资产总计", "合并", "1", "2"), ("资产总计", "合并", "资产总计", "x")], "label string, scope string, claimed_span string, claimed_value string")
    got = tools.verify_span(r, chunks)
    assert column(got, "accepted") == [True, False, None] and column(got, "error")[2] == "VALUE_UNPARSED"
    r = requests(spark, [("F1", "合并", "current"), ("F4", "合并", "current"), ("F3a", "合并", "current"), ("F9", None, "current"), ("F1", None, "current"), ("F1", "合并", "prior")], "formula_id string, scope string, period string")
    got = tools.compute(r, chunks, facts)
    assert column(got, "verdict")[:2] == ["PASS", "PASS"] and column(got, "error") == [None, None, "MISSING_OPERANDS", "FORMULA_NOT_FOUND", "AMBIGUOUS_SCOPE", None]
    r = requests(spark, [("资产总计", "合并", "资产总计", "母公司", "current"), ("资产总计", "合并", "没有", None, "current"), ("结算备付金", "合并", "资产总计", "合并", "current")], "label_a string, scope_a string, label_b string, scope_b string, period string")
    got = tools.diff_two_rows(r, chunks)
    assert column(got, "value")[0] == Decimal("298944574918.70") and column(got, "error") == [None, "LABEL_NOT_FOUND", "NON_NUMERIC"]
    assert tools.list_formulas(spark, "identity").count() == 6
    assert tools.locate_rows(requests(spark, [(1, "a", "b")], "page int, label string, value string"), None).first().error == "NO_PDF"


def test_statistics(spark):
    rows = [("ANSWER", "ANSWER", None, True, 5, 10.0, 100), ("ANSWER", "REFUSE", "not_answered", False, 3, 30.0, 0), ("REFUSE", "REFUSE", None, True, 1, 20.0, 50), ("REFUSE", "ANSWER", "answered_but_should_refuse", False, 5, 40.0, 0)]
    df = spark.createDataFrame(rows, "expected_outcome string, decision string, failure string, passed boolean, tool_calls int, latency_ms double, tokens bigint")
    r = evaluation.eval_stats(df).first()
    assert (r.total, r.passed, r.pass_rate, r.right_answers, r.right_refusals, r.false_answers, r.aborts, r.p50_ms, r.p95_ms, r.tokens_per_billed) == (4, 2, 0.5, 1, 1, 1, 0, 30.0, 40.0, 75.0)
    assert [x.n for x in evaluation.failures(df).collect()] == [1, 1]


def test_vocabulary_helps(spark):
    labels = ["营业收入", "营业外收入", "手续费及佣金收入", "营业外支出", "其他收益"]
    chunks = spark.createDataFrame([(f"c{i}", "d", x, x) for i, x in enumerate(labels)], "chunk_id string, doc_id string, label string, text string")
    q = spark.createDataFrame([(f"q{i}", "d", f"2024年{x}是多少", x) for i, x in enumerate(labels)], "question_id string, doc_id string, question string, label string")
    got = {r.vocabulary: r.hits for r in evaluation.vocabulary_ablation(q, chunks).collect()}
    assert got["with"] == 5 and got["without"] <= 5


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.md").write_text(REPORT)
    (tmp_path / "bank.jsonl").write_text(json.dumps(ITEM))
    (tmp_path / "q.jsonl").write_text(json.dumps({"question_id": "a", "doc_id": "m", "question": ITEM["question"]}))
    index, facts = str(tmp_path / "index"), str(tmp_path / "index" / "facts")
    cli.main(["build-index", str(tmp_path / "in" / "*.md"), index])
    cli.main(["answer", index, facts, str(tmp_path / "q.jsonl"), str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).first().decision == "ANSWER"
    for command in (["evaluate", index, facts], ["check-bank"], ["gold-check", index]):
        cli.main([*command, str(tmp_path / "bank.jsonl")])
    assert "|all" in capsys.readouterr().out.replace(" ", "")
    cli.main(["gold-check", index, str(tmp_path / "bank.jsonl"), "--source", str(tmp_path / "in" / "*.md")])
    row = [x for x in capsys.readouterr().out.replace(" ", "").splitlines() if ITEM["item_id"] in x][0].split("|")
    assert row[2:6] == ["true"] * 4  # the third gate is met by the report itself


def test_lines_of_a_bank_that_are_no_items(spark, tmp_path, capsys):
    path = tmp_path / "bank.jsonl"
    path.write_text("# a note\n\n" + json.dumps(ITEM) + "\n{broken\n" + json.dumps(ITEM) + "\n[1]\n")
    bad = bank.bad_lines(spark, str(path)).collect()
    assert [(r.line, r.text) for r in bad] == [(4, "{broken"), (6, "[1]")] and bad[0].file.endswith("bank.jsonl")
    with pytest.raises(Exception, match=r"bank\.jsonl: (\{broken|\[1\])"):
        bank.read_bank(spark, str(path)).collect()
    cli.main(["check-bank", str(path)])
    assert "{broken" in capsys.readouterr().out
