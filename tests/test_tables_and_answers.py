"""From page-marked text to verified answers; evidence, formulas, geometry, evaluation."""

import json
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyproof.operators import evidence, formulas, geometry, retrieval, tables
from tallyproof.plans import answer, evaluation
from tallyproof.sources import bank, documents, index_store, trace

HEADER = "<tr><td>项目</td><td>附注</td><td>2024年12月31日</td><td>2023年12月31日</td></tr>"
REPORT = f"""skipped | text
<!-- page 58 of 143 -->
编制单位:贵州茅台酒股份有限公司
单位:元
## 合并资产负债表
<table>{HEADER}<tr><td colspan="4">流动资产:</td></tr><tr><td>货币资金</td><td>1</td><td>59,295,822,956.89</td><td>69,070,136,376.12</td></tr><tr><td>结算备付金</td><td></td><td></td><td></td></tr></table>
<!-- page 59 of 143 -->
| 资产总计 |  | 298,944,579,918.70 | 272,699,660,092.25 |
| 负债合计 |  | 56,933,264,798.10 | 49,043,191,200.23 |
| 所有者权益（或股东权益）合计 |  | 242,011,315,120.60 | 223,656,468,892.02 |
<!-- page 61 of 143 -->
## 母公司资产负债表
| 项目 | 附注 | 2024年12月31日 | 2023年12月31日 |
| --- | :--- | --- | --- |
| 货币资金 | | 1,000.00 | 2,000.00 |
| 资产总计 | | 5,000.00 | 4,000.00 |
<!-- page 63 of 143 -->
## 合并利润表
<table>{HEADER}<tr><td>一、营业总收入</td><td></td><td>1,500.00</td><td>1,400.00</td></tr><tr><td>其中:营业收入</td><td></td><td>1,000.00</td><td>900.00</td></tr><tr><td>营业成本</td><td></td><td>250.00</td><td>200.00</td></tr><tr><td>净利润</td><td></td><td>600.00</td><td>500.00</td></tr><tr><td>归属于母公司所有者的净利润</td><td></td><td>580.00</td><td>490.00</td></tr></table>
"""


@pytest.fixture(scope="module")
def report(spark):
    docs = spark.createDataFrame([("m", REPORT)], "doc_id string, text string")
    chunks = tables.build_chunks(docs).cache()
    years = tables.logical_tables(tables.stitch(tables.blocks(tables.pages(docs)))).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("report_years")))).alias("years"))
    facts = tables.issuer(docs).join(tables.declared_unit(docs.withColumn("priority", F.lit(0))), "doc_id").join(years, "doc_id").cache()
    return docs, chunks, facts, index_store.build(chunks)


def blocks_of(spark, text):
    return tables.blocks(tables.pages(spark.createDataFrame([("d", text)], "doc_id string, text string")))


def test_pages_and_blocks(spark, report):
    got = tables.blocks(tables.pages(report[0])).orderBy("ord").collect()
    assert [(r.page, r.serialization, r.caption, r.width, r.head_like) for r in got] == [(58, "html", "合并资产负债表", 4, True), (59, "markdown", "合并资产负债表", 4, False), (61, "markdown", "母公司资产负债表", 4, True), (63, "html", "合并利润表", 4, True)]
    assert len(got[0].rows) == 4 and got[0].rows[3][1].text == "" and len(got[2].rows) == 3
    assert blocks_of(spark, "no markers | at all").count() == 0


def test_logical_tables(spark, report):
    got = tables.logical_tables(tables.stitch(tables.blocks(tables.pages(report[0])))).orderBy("table_index").collect()
    assert [(r.page_span, r.scope, r.serializations, r.blocks, r.flags) for r in got] == [("p58-p59", "合并", ["html", "markdown"], 2, []), ("p61", "母公司", ["markdown"], 1, []), ("p63", "合并", ["html"], 1, [])]
    assert got[0].report_years == [2023, 2024]


@pytest.mark.parametrize("text,tables_,flag", [
    ("<!-- page 1 of 9 -->\n| 项目 | a |\n| x | 1 |\n<!-- page 2 of 9 -->\n| 项目 | a |\n| y | 2 |", 2, None), ("<!-- page 1 of 9 -->\n| 项目 | a |\n<!-- page 4 of 9 -->\n| y | 2 |", 2, "doesn't continue"),
    ("<!-- page 1 of 9 -->\n| 项目 | a |\n<!-- page 2 of 9 -->\n| y | 2 | 3 |", 2, "columns"), ("<!-- page 1 of 9 -->\n| y | 2 |", 1, "first block"), ("<!-- page 1 of 9 -->\n| 项目 | a |\n<!-- page 2 of 9 -->\n| y | 2 |", 1, None),
])
def test_stitching(spark, text, tables_, flag):
    got = tables.logical_tables(tables.stitch(blocks_of(spark, text))).orderBy("table_index").collect()
    assert len(got) == tables_
    assert (got[-1].flags == []) if flag is None else flag in got[-1].flags[0]


def test_stitch_equals_a_sequential_fold(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for d in range(60):
        page, prev, ti = 1, None, -1
        for o in range(rng.randrange(1, 12)):
            page += rng.choice([0, 1, 1, 1, 2])
            b = (page, rng.choice([3, 3, 4]), rng.random() < 0.25)
            if b[2] or prev is None or not (page == prev[0] + 1 and b[1] == prev[1]):
                ti += 1
            want[d, o], prev = ti, b
            rows.append((d, o, *b))
    got = tables.stitch(spark.createDataFrame(rows, "doc_id int, ord int, page int, width int, head_like boolean")).collect()
    assert {(r.doc_id, r.ord): r.table_index for r in got} == want


def test_chunks(report):
    got = {r.chunk_id: r for r in report[1].collect()}
    assert got["m#t0r1"].label == "货币资金" and got["m#t0r1"].section == "流动资产:" and got["m#t0r1"].values == ["59,295,822,956.89", "69,070,136,376.12"] and got["m#t0r1"].text == "货币资金 | 流动资产: | 59,295,822,956.89 | 69,070,136,376.12"
    assert got["m#t0r2"].values == ["", ""] and got["m#t0r2"].compact_values == [] and got["m#t0r3"].continuation and got["m#t0r3"].page == 59
    assert got["m#t2r0"].label == "营业总收入" and got["m#t2r1"].label == "营业收入" and "m#t0r0" not in got
    assert tables.to_markdown(tables.table_rows(tables.stitch(tables.blocks(tables.pages(report[0]))))).where("line LIKE '| 资产总计 |%<!-- p59 -->'").count() == 1


def test_facts(report):
    r = report[2].first()
    assert (r.company, r.unit, r.years) == ("贵州茅台酒股份有限公司", "元", [2023, 2024])


def chunk_table(spark, rows):
    full = [(cid, "d", 0, i, page, label, None, values, values, " | ".join([label, *values]), None, False) for i, (cid, label, values, page) in enumerate(rows)]
    schema = "chunk_id string, doc_id string, table_index int, row_index int, page int, label string, section string, values array<string>, compact_values array<string>, text string, scope string, continuation boolean"
    return index_store.build(spark.createDataFrame(full, schema))


def ask(spark, index, q, **kw):
    hits = retrieval.retrieve(spark.createDataFrame([("q", "d", q)], "question_id string, doc_id string, question string"), index, **kw)
    return [(r.chunk_id, r.via) for r in hits.orderBy("rank").collect()]


def test_channels(spark):
    index = chunk_table(spark, [("a", "资产总计", ["298,944,579,918.70"], 1), ("b", "负债合计", ["56,933,264,798.10"], 1), ("c", "非流动负债合计", ["298,944,579,918.71"], 1), ("e", "其他应收款", ["5"], 1), ("f", "其他", ["6"], 1), ("g", "营业收入", ["7"], 1), ("h", "营业外收入", ["8"], 1)])
    assert ask(spark, index, "298944579918.70", channels=("numeric",)) == [("a", ["numeric"])]
    assert ask(spark, index, "负债合计")[0][0] == "b"
    assert ask(spark, index, "其他应收款是多少？")[0][0] == "e"
    assert ask(spark, index, "2024年营业收入是多少", channels=("lexical",))[0][0] == "g"
    assert ask(spark, index, "火星基地的折旧是多少？") == [] and ask(spark, index, "资产总计", channels=("vector",)) == []


def test_rrf(spark):
    rows = [("q", "x", "label", 1), ("q", "y", "label", 2), ("q", "y", "lexical", 1)]
    got = {r.chunk_id: r for r in retrieval.fuse(spark.createDataFrame(rows, "question_id string, chunk_id string, channel string, rank int")).collect()}
    assert got["y"].score == 1 / 62 + 1 / 61 > got["x"].score == 1 / 61 and got["y"].via == ["label", "lexical"] and got["y"].ranks == {"label": 2, "lexical": 1}


def test_index_round_trip(spark, report, tmp_path):
    index_store.write(report[3], str(tmp_path), buckets=4)
    back = index_store.load(spark, str(tmp_path))
    assert {k: v.count() for k, v in back.items()} == {k: v.count() for k, v in report[3].items()}
    assert index_store.lookup(back, spark.createDataFrame([("m#t0r1",)], "chunk_id string")).first().label == "货币资金"
    assert [r.n for r in index_store.scope_report(report[1]).collect()] == [10, 2]


INCOME = "营业收入 1,234,567,890.12 元，营业成本 500,000,000.00 元"


@pytest.mark.parametrize("claim,text,value,unit,tol,want", [
    ("营业收入 1,234,567,890.12", INCOME, "1234567890.12", "元", 0, (True, None, "exact")), ("营业收入1,234,567,890.12", INCOME, "1234567890.12", None, 0, (True, None, "normalized")), ("营业收入 9,999", INCOME, "9999", None, 0, (False, "SPAN_NOT_FOUND", None)),
    (" ", INCOME, "1", None, 0, (False, "EMPTY_SPAN", None)), (None, INCOME, "1", None, 0, (False, "EMPTY_SPAN", None)), ("营业成本", "", "1", None, 0, (False, "SPAN_NOT_FOUND", None)), ("营业收入 1,234,567,890.12", INCOME, "12.35", "亿元", 0, (False, "VALUE_NOT_IN_SPAN", "exact")), ("营业收入 1,234,567,890.12", INCOME, "12.35", "亿元", "0.001", (True, None, "exact")),
])
def test_evidence(spark, claim, text, value, unit, tol, want):
    df = spark.createDataFrame([(claim, text, value, unit)], "c string, t string, v string, u string")
    r = df.select(evidence.verify_evidence(F.col("c"), F.col("t"), F.col("v").cast("decimal(28,8)"), F.col("u"), tol).alias("r")).first().r
    assert (r.accepted, r.reason, r.mode) == want


def test_guards(spark):
    df = spark.createDataFrame([("净利润", "归母净利润是多少"), ("归属于母公司股东的净利润", "归母净利润是多少"), ("投资活动现金流入小计", "现金净增加额与净利润"), ("净利润", "天气如何"), (None, "净利润")], "c string, q string")
    labels = F.array(*[F.lit(x) for x in ("净利润", "归属于母公司股东的净利润", "投资活动现金流入小计")])
    assert [r[0] for r in df.select(evidence.label_error(F.col("q"), F.col("c"), labels)).collect()] == ["part_of_item", None, "other_item", "none_named", "no_label"]
    missing = evidence.missing_fields(a=F.lit("x"), b=F.lit(" "), c=F.lit(None).cast("string"), d=F.lit(0))
    assert spark.range(1).select(missing.alias("m")).first().m == ["b", "c"]


def d(v):
    return F.lit(v).cast("decimal(28,8)")


def operands(spark, fid, unit="元", **values):
    rows = [("k", fid, n, None if v is None else Decimal(v), unit) for n, v in values.items()]
    return formulas.evaluate(spark.createDataFrame(rows, "doc string, formula_id string, name string, value decimal(28,8), unit string"), ["doc"]).first()


def test_identities(spark):
    ok = operands(spark, "F1", 资产总计="1000000000", 负债合计="400000000", 所有者权益合计="600000000", extra="5")
    assert (ok.verdict, ok.diff, ok.tolerance) == ("PASS", 0, Decimal("1.5"))
    off = dict(资产总计="1000000000", 负债合计="400000000", 所有者权益合计="600005000")
    assert operands(spark, "F1", "万元", **off).verdict == "PASS" and operands(spark, "F1", "万元", **off).tolerance == 15000 and operands(spark, "F1", "元", **off).verdict == "FAIL"
    gone = operands(spark, "F1", 资产总计="10", 负债合计="4", 所有者权益合计=None)
    assert (gone.verdict, gone.missing, gone.error, gone.lhs) == ("WARN", ["所有者权益合计"], "MISSING_OPERANDS", None)
    assert operands(spark, "F2a", 净利润="750", 利润总额="1000", 所得税费用="250").verdict == "PASS"
    assert operands(spark, "F9", x="1").error == "FORMULA_NOT_FOUND"
    bad = operands(spark, "F1", 资产总计="1000", 负债合计="400", 所有者权益合计="0.01")
    assert bad.verdict == "FAIL" and bad.suspects == []


def test_other_formulas(spark):
    assert operands(spark, "F4", 营业收入="1000", 营业成本="250").lhs == Decimal("75.00") and operands(spark, "F4", 营业收入="0", 营业成本="1").verdict == "WARN"
    assert operands(spark, "F5", 外币金额="100", 折算汇率="7.1", 本币列示金额="712").verdict == "PASS" and operands(spark, "F5", 外币金额="100", 折算汇率="7.1", 本币列示金额="800").verdict == "FAIL"
    assert [operands(spark, "F6", 本期值=a, 上期值=b).verdict for a, b in (("120", "100"), ("500", "100"), ("-5", "100"), ("5", "-1"))] == ["PASS", "WARN", "WARN", "WARN"]
    claim = formulas.gross_margin(d("1000"), d("250"), F.lit("74.50").cast("decimal(18,2)"))
    assert spark.range(1).select(claim["verdict"].alias("v")).first().v == "FAIL"


@pytest.mark.parametrize("diff,want", [("600000000", ["所有者权益合计"]), ("50000000", []), ("0", [])])
def test_suspects(spark, diff, want):
    ops = F.array(F.struct(F.lit("负债合计").alias("name"), d("400000000").alias("value")), F.struct(F.lit("所有者权益合计").alias("name"), d("600000000").alias("value")))
    assert spark.range(1).select(formulas.suspects(ops, d(diff)).alias("s")).first().s == want
    shift = F.array(F.struct(F.lit("负债合计").alias("name"), d("100").alias("value")))
    assert spark.range(1).select(formulas.suspects(shift, d("900")).alias("s")).first().s == ["负债合计"]


QUESTIONS = {
    "2024年合并资产负债表的资产总计是多少？": ("ANSWER", None), "货币资金是多少": ("REFUSE", "AMBIGUOUS_SCOPE"), "合并报表的资产总计是否等于负债合计与所有者权益合计之和": ("ANSWER", None), "2019年合并资产总计是多少": ("REFUSE", "OUT_OF_DOCUMENT_PERIOD"),
    "五粮液2024年合并货币资金": ("REFUSE", "WRONG_DOCUMENT"), "2024年现金流是多少": ("REFUSE", "AMBIGUOUS_ABBREVIATION"), "合并口径的资产总计与母公司口径的资产总计相差多少": ("ANSWER", None), "火星基地2024年的折旧年限是多少年？": ("REFUSE", "NO_RECALL"),
    "2024年母公司货币资金": ("ANSWER", None), "合并利润表的毛利率": ("ANSWER", None), "": (None, None), "合并现金流量表中经营、投资、筹资活动加总是否等于净增加额": ("REFUSE", "MISSING_OPERANDS"), "2024年合并利润表的归母净利润是多少": ("REFUSE", "LABEL_MISMATCH"),
}


@pytest.fixture(scope="module")
def answered(spark, report):
    qs = spark.createDataFrame([(f"{i:02d}", "m", q) for i, q in enumerate(QUESTIONS)], "question_id string, doc_id string, question string")
    return {r.question: r for r in answer.answer(qs, report[2], report[3]).collect()}


def test_answers(answered):
    for q, want in QUESTIONS.items():
        if q != "2024年合并利润表的归母净利润是多少":
            assert (answered[q].decision, answered[q].reason) == want, q
    a = answered["2024年合并资产负债表的资产总计是多少？"]
    assert (a.value, a.unit, a.pages, a.scope, a.company, a.period, a.span_mode) == (Decimal("298944579918.70"), "元", [59], "合并", "贵州茅台酒股份有限公司", "2024 年度", "exact")
    b = answered["合并报表的资产总计是否等于负债合计与所有者权益合计之和"]
    assert (b.route, b.verdict, b.diff, b.pages) == ("VERIFY", "PASS", 0, [59]) and len(b.operands) == 3
    c = answered["合并口径的资产总计与母公司口径的资产总计相差多少"]
    assert c.value == Decimal("298944574918.70") and c.indicator == "资产总计（合并） − 资产总计（母公司）" and c.pages == [59, 61]
    assert answered["合并利润表的毛利率"].lhs == Decimal("75.00") and answered[""].input_error == "empty"
    assert all(r.steps <= answer.BUDGETS["steps"] for r in answered.values())


def test_small_budgets_abort(spark, report):
    q = spark.createDataFrame([("q", "m", "2024年母公司货币资金")], "question_id string, doc_id string, question string")
    r = answer.answer(q, report[2], report[3], budgets={"steps": 3, "tool_calls": 2}).first()
    assert (r.decision, r.reason) == ("ABORT", "BUDGET_EXCEEDED")


def test_reverse_lookup(spark, report):
    q = spark.createDataFrame([("q", "m", "298,944,579,918.70")], "question_id string, doc_id string, question string")
    assert answer.reverse_lookup(q, report[3]).first().label == "资产总计"


def box(*v):
    return F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), v)])


def test_boxes(spark):
    p = F.lit(1)
    row = lambda a, b: geometry.same_row(p, a, p, b)
    r = spark.range(1).select(
        row(box(0, 100, 1, 120), box(2, 112, 3, 122)).alias("tall"), row(box(0, 700, 1, 710.6), box(2, 713.8, 3, 724.4)).alias("apart"), geometry.same_row(p, box(0, 0, 1, 1), F.lit(2), box(0, 0, 1, 1)).alias("pages"),
        geometry.vertical_distance(p, box(0, 100, 1, 110), p, box(0, 130, 1, 120)).alias("gap"), geometry.union_box(box(0, 5, 1, 6), box(3, 2, 4, 4)).alias("u"), geometry.is_empty(box(1, 1, 1, 2)).alias("e"), geometry.vertical_distance(p, box(0, 0, 1, 1), F.lit(2), box(0, 0, 1, 1)).alias("far"),
    ).first()
    assert (r.tall, r.apart, r.pages, r.gap, tuple(r.u), r.e, r.far) == (True, False, False, 20.0, (0.0, 2.0, 4.0, 6.0), True, float("inf"))


def test_locate_rows(spark):
    words = [(1, 10.0, 100.0, 40.0, 110.0, "资产", 0, 0), (1, 41.0, 100.0, 70.0, 110.0, "总计", 0, 0), (1, 200.0, 101.0, 260.0, 111.0, "1,234.00", 0, 0), (1, 200.0, 300.0, 260.0, 310.0, "1,234.00", 1, 5)]
    w = spark.createDataFrame(words, "page int, x0 double, y0 double, x1 double, y1 double, text string, block int, line int")
    find = lambda t: geometry.find_text(spark.createDataFrame([("p", 1, t)], "target_id string, page int, target string"), w).withColumnRenamed("target_id", "pair_id")
    labels, values = find("资产总计"), find("1,234.00")
    assert labels.count() == 1 and values.count() == 2
    r = geometry.locate_rows(spark.createDataFrame([("p",), ("none",)], "pair_id string"), labels, values).orderBy("pair_id").collect()
    assert r[1].same_row and tuple(r[1].row_box) == (10.0, 100.0, 260.0, 111.0) and not r[0].same_row and r[0].row_box is None
    assert documents.page_text(w.withColumn("doc_id", F.lit("d"))).first().text.startswith("资产 总计")


ITEM = {
    "item_id": "B-DOC_2024-001", "track": "B", "doc": "m", "company": "c", "period": "2024", "question": "2024年合并资产负债表的资产总计是多少？", "question_type": "L1", "expected_outcome": "ANSWER", "scope": "合并", "gold_value": "298,944,579,918.70",
    "gold_unit": "元", "gold_pages": [59], "gold_evidence": ["资产总计 | 流动资产: | 298,944,579,918.70"], "gold_operands": {}, "difficulty": "easy", "source": "own",
}


def items(spark, tmp_path, *changes):
    path = tmp_path / f"bank{len(list(tmp_path.iterdir()))}.jsonl"
    path.write_text("# note\n\n" + "\n".join(json.dumps(ITEM | {"item_id": f"B-DOC_2024-{i:03d}", "question": ITEM["question"] + "？" * i} | c) for i, c in enumerate(changes)))
    return bank.read_bank(spark, str(path))


def test_bank(spark, tmp_path):
    good = items(spark, tmp_path, {}, {"question_type": "R", "expected_outcome": "REFUSE", "refusal_reason": "x", "gold_value": None, "gold_unit": None, "gold_pages": [], "gold_evidence": [], "scope": "不适用"})
    assert evaluation.validate_bank(good).count() == 0 and good.count() == 2
    bad = items(spark, tmp_path, {"gold_unit": None}, {"scope": "母公司"}, {"question_type": "L2", "formula": "F1"}, {"gold_pages": [0]}, {"item_id": "x"}, {"question_type": "R"}, {"question": "同", "item_id": "B-A-001"}, {"question": "同", "item_id": "B-A-001"})
    got = {r.item_id: r.problems for r in evaluation.validate_bank(bad).collect()}
    assert "gold_unit is missing" in got["B-DOC_2024-000"] and "consolidated scope named, scope differs" in got["B-DOC_2024-001"] and {"gold_verdict is missing", "verdict item has a gold_value"} <= set(got["B-DOC_2024-002"])
    assert "gold_pages must begin at 1" in got["B-DOC_2024-003"] and "item_id has a wrong form" in got["x"] and "R item must be refused" in got["B-DOC_2024-005"] and {"item_id is repeated", "question is repeated"} <= set(got["B-A-001"])
    stats = {(r.dimension, r.value): r.n for r in bank.bank_stats(good).collect()}
    assert stats["question_type", "R"] == 1 and stats["doc", "m"] == 2
    bank.write_bank(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_bad_json_is_an_error(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"item_id": ')
    with pytest.raises(Exception):
        bank.read_bank(spark, str(tmp_path / "b.jsonl")).collect()


def test_compare_and_negative_control(spark, report, tmp_path):
    refused = {"question_type": "R", "expected_outcome": "REFUSE", "refusal_reason": "x", "gold_value": None, "gold_unit": None, "gold_pages": [], "gold_evidence": [], "question": "货币资金是多少"}
    verdict = {"question_type": "L2", "formula": "F1", "gold_value": None, "gold_unit": None, "gold_verdict": "PASS", "gold_operands": {"资产总计": "298,944,579,918.70"}, "question": "合并报表的资产总计是否等于负债合计与所有者权益合计之和"}
    b = items(spark, tmp_path, {}, refused | {"expected_refusal_code": "AMBIGUOUS_SCOPE"}, refused | {"expected_refusal_code": "NO_RECALL"}, verdict, verdict | {"gold_operands": {"资产总计": "1"}}, verdict | {"gold_verdict": "FAIL"}, {"gold_value": "1"}, {"gold_pages": [3]}, refused | {"question": ITEM["question"]})
    qs = b.select(F.col("item_id").alias("question_id"), F.col("doc").alias("doc_id"), "question")
    got = evaluation.compare(b, answer.answer(qs, report[2], report[3])).orderBy("item_id").collect()
    assert [r.failure for r in got] == [None, None, "wrong_refusal_reason", None, "wrong_operands", "wrong_verdict", "wrong_value", "wrong_page", "answered_but_should_refuse"]
    rates = {(r.dimension, r.value): (r.passed, r.total) for r in evaluation.pass_rates(spark.createDataFrame(got)).collect()}
    assert rates["all", "all"] == (3, 9) and rates["question_type", "L2"] == (1, 3)


def test_gold_gates(spark, report, tmp_path):
    b = items(spark, tmp_path, {}, {"gold_evidence": ["没有的"]}, {"gold_pages": [58]})
    pages = documents.chunk_pages(report[1])
    got = evaluation.gold_gates(b, pages, pages).orderBy("item_id").collect()
    assert [(r.g1, r.g2, r.g3) for r in got] == [(True, True, True), (True, False, True), (False, False, False)] and got[0].value_pages == [59]
    assert not evaluation.gold_gates(b, pages).orderBy("item_id").first().g3


@pytest.mark.parametrize("values,p,want", [([], 0.5, 0.0), ([3.0], 0.95, 3.0), ([1.0, 2.0, 3.0, 4.0], 0.5, 3.0), ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 0.5, 3.0)])
def test_nearest_rank(spark, values, p, want):
    assert spark.createDataFrame([(values,)], "v array<double>").select(evaluation.nearest_rank(F.col("v"), p).alias("x")).first().x == want


def test_usage(spark):
    calls = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 3, 25)], "item_id string, ord int, total_tokens int")
    assert [(r.tokens, r.billed) for r in evaluation.usage_per_question(calls).orderBy("ord").collect()] == [(10, True), (0, False), (15, True)]


def test_trace(spark, tmp_path):
    rows = [("r1", 1, "GUARD", "check", "{}", True, "d" * 90, "policy"), ("r1", 2, "SEARCH", "search", "{}", False, None, "policy"), ("r1", 3, "X", None, "{}", None, "", "policy")]
    steps = spark.createDataFrame(rows, "run_id string, seq int, node string, tool string, args string, ok boolean, detail string, source string")
    text = trace.replay(steps).first().text.split("\n")
    assert [t[3] for t in text] == ["✓", "✗", "·"] and text[0].endswith("d" * 60) and not text[0].endswith("d" * 61)
    path = str(tmp_path / "runs")
    for decision in ("REFUSE", "ANSWER"):
        trace.append(spark.createDataFrame([("r1", "q", decision)], "run_id string, question string, decision string").withColumn("started_at", F.current_timestamp()), path)
    assert [r.decision for r in trace.runs(spark, path, 500).collect()] == ["ANSWER"]


def test_streams(spark, tmp_path):
    from tallyproof.streaming import trace as stream

    src = str(tmp_path / "in")
    rows = [(f"r{i}", "GUARD" if i % 2 else "SEARCH", i % 3 > 0, i) for i in range(30)]
    spark.createDataFrame(rows, "run_id string, node string, ok boolean, s int").withColumn("at", F.timestamp_seconds(F.col("s") * 20 + 1_700_000_000)).drop("s").write.parquet(src)
    live = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    stream.append_trace(live, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    q = stream.step_counts(live).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(steps) s, sum(failed) f FROM counts").first() == (30, 10)
    burst = live.select(F.lit("c").alias("client"), "at")
    q = stream.token_bucket(burst, rate=0.01, burst=2).writeStream.format("memory").queryName("bucket").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) n, count_if(admitted) a FROM bucket").first() == (30, 7)


def test_read_documents(spark, tmp_path):
    (tmp_path / "rep.md").write_text(REPORT)
    assert documents.read_documents(spark, str(tmp_path / "*.md")).first().doc_id == "rep"


def test_selection_equals_sorting_in_any_group(spark):
    rng = random.Random(3)
    groups = {"hot": [rng.lognormvariate(0, 5) for _ in range(3000)], None: [1.0] * 50, "one": [7.5], "ties": [rng.choice([1.0, 2.0, 3.0]) for _ in range(500)], "far": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324] * 3, "odd": [float("nan"), float("inf"), None, 4.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None)]
    ps = {"p0": 0.0, "p01": 0.01, "p50": 0.5, "p95": 0.95, "p1": 1.0}
    few = [x for x in rows if x[0] in ("ties", "one", "odd")]
    for ranges, some in ((2, few), (1024, rows)):
        got = {r.g: r for r in evaluation.nearest_rank_by(spark.createDataFrame(some, "g string, v double"), ["g"], "v", ps, ranges=ranges, digits=None).collect()}
        for g, r in got.items():
            v = sorted(x for x in groups[g] if x is not None and abs(x) < float("inf"))
            assert [r[k] for k in ps] == [v[round((len(v) - 1) * p)] for p in ps.values()], g
    assert "none" not in got and len(got) == 6


@pytest.mark.parametrize("seed", range(3))
def test_range_join_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    side = lambda n: [(i, rng.randint(1, 3), y, y + rng.choice([0.0, 5.0, 12.0, 300.0 if rng.random() < 0.05 else 8.0])) for i in range(n) for y in [rng.choice([rng.uniform(-50, 900), float(rng.randint(0, 80) * 11)])]]
    left, right = side(150), side(120) + [(900, 1, None, 1.0), (901, 1, float("nan"), 1.0)]
    frame = lambda rows, i, c: spark.createDataFrame(rows, f"{i} int, page int, y0 double, y1 double").select(i, "page", F.struct(F.lit(0.0).alias("x0"), "y0", F.lit(1.0).alias("x1"), "y1").alias(c))
    got = geometry.row_pairs(frame(left, "l", "lbox"), frame(right, "r", "rbox"), ["page"])
    want = sorted((a[0], b[0]) for a in left for b in right[:-2] if a[1] == b[1] and not (a[3] + 1 < b[2] or b[3] + 1 < a[2]))
    assert sorted((x.l, x.r) for x in got.collect()) == want and len(want) > 100


def test_range_join_makes_no_pairs_of_far_boxes(spark):
    """A page of n rows: as many pairs come out of the join as overlap nearby, not n * n."""
    n = 3000
    rows = spark.range(n).select("id", F.lit(1).alias("page"), F.struct(F.lit(0.0).alias("x0"), (F.col("id") * 20.0).alias("y0"), F.lit(1.0).alias("x1"), (F.col("id") * 20.0 + 10).alias("y1")).alias("b"))
    got = geometry.row_pairs(rows.withColumnRenamed("b", "lbox"), rows.withColumnRenamed("b", "rbox").withColumnRenamed("id", "other"), ["page"])
    assert got.count() == n
    got.collect()
    made = [int(x.replace(",", "")) for x in re.findall(r"number of output rows: ([0-9,]+)", str(got._jdf.queryExecution().executedPlan().toString()))]
    assert not made or max(made) < 10 * n


def test_repeated_and_nameless_operands_are_no_crash(spark):
    rows = [("same", "F4", "营业收入", "10.00"), ("same", "F4", "营业收入", "10.00"), ("same", "F4", "营业成本", "4.00"), ("two", "F4", "营业收入", "10.00"), ("two", "F4", "营业收入", "11.00"), ("two", "F4", "营业成本", "4.00"),
        ("half", "F4", "营业收入", None), ("half", "F4", "营业收入", "10.00"), ("half", "F4", "营业成本", "4.00"), ("none", "F4", None, "1.00"), ("none", "F4", None, "2.00"), ("odd", "F99", "营业收入", "1.00")]
    asked = spark.createDataFrame(rows, "k string, formula_id string, name string, value string").withColumn("value", F.col("value").cast("decimal(28,8)")).withColumn("unit", F.lit("元"))
    got = {r.k: r for r in formulas.evaluate(asked, ["k"]).collect()}
    assert {k: r.error for k, r in got.items()} == {"same": None, "two": "CONFLICTING_OPERANDS", "half": None, "none": "MISSING_OPERANDS", "odd": "FORMULA_NOT_FOUND"}
    assert got["same"].lhs == got["half"].lhs and got["two"].missing == ["营业收入"] and got["none"].missing == ["营业收入", "营业成本"]


def _joined(df) -> int:
    """Rows that the joins of a frame make in all, as it runs."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()

        def rows(node) -> int:
            own = node.metrics().get("numOutputRows").get().value() if "Join" in node.nodeName() else 0
            children = node.children()
            return own + sum(rows(children.apply(i)) for i in range(children.size()))

        return rows(df._jdf.queryExecution().executedPlan())
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_numeric_channel_meets_the_first_chunks_of_a_value(spark):
    """A value of many chunks: the first ones of all values, also where rows repeat, and no more pairs than that."""
    from tallyproof.operators import retrieval

    number = [("d", f"c{i:04d}", Decimal(v)) for i in range(600) for v in ((100, 200) if i % 2 else (200,))] * 2 + [("e", "c0", Decimal(100))]
    number = spark.createDataFrame(number, "doc_id string, chunk_id string, value decimal(38,8)")
    asked = spark.createDataFrame([(f"q{i}", "d", "is it 100 or 200" if i else "is it 100") for i in range(300)] + [("none", "d", "is it 7")], "question_id string, doc_id string, question string")
    out = retrieval.numeric_channel(asked, number, 3)
    assert _joined(out) <= 2 * 300
    got = {}
    for r in out.collect():
        got.setdefault(r.question_id, {})[r["rank"]] = r.chunk_id
    assert got["q0"] == {1: "c0001", 2: "c0003", 3: "c0005"} and got["q7"] == {1: "c0000", 2: "c0001", 3: "c0002"} and len(got) == 300


def test_nearest_in_row_equals_all_pairs(spark):
    """Heights of all kinds, equal centres, ties on both sides, empty bins between, null and non-finite boxes; crowded pages make no pairs."""
    import random

    from tallyproof.operators import geometry

    rng = random.Random(5)
    box = lambda y, h: (0.0, y - h / 2, 1.0, y + h / 2)
    some = lambda n, base: [(base + i, rng.choice(["p", "q", None]), box(rng.choice([rng.randint(0, 60) / 2, rng.uniform(-300, 300)]), rng.choice([0, 0.5, 3, 40]))) for i in range(n)]
    nan = float("nan")
    left = some(150, 0) + [(900, "p", None), (901, "p", (0.0, nan, 1.0, 2.0)), (902, "alone", box(0, 1)), (3, "q", box(5, 1))]
    right = some(150, 1000) + [(1900, "p", (0.0, 1.0, 1.0, nan)), (1901, "p", None)]
    frame = lambda rows, id, b: spark.createDataFrame(rows, f"{id} int, page string, {b} struct<x0: double, y0: double, x1: double, y1: double>")
    l, r = frame(left, "id", "lbox"), frame(right, "other", "rbox")
    got = sorted((x.id, x.page, x.lbox.y0, x.gap, x.other) for x in geometry.nearest_in_row(l, r, ["page"], "other").collect())
    want = []
    for i, page, a in left:
        met = [(abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2), o) for o, p, b in right if a and b and p == page and p and nan not in (a[1], b[3]) and not (a[3] + 1 < b[1] or b[3] + 1 < a[1]) and a[1] == a[1] and b[3] == b[3]]
        want += [(i, page, a[1], *min(met))] if met else []
    assert got == sorted(want)
    crowd = spark.range(4000).selectExpr("cast(id AS int) AS k", "'p' AS page", "struct(0D AS x0, (id % 97) / 10D AS y0, 1D AS x1, (id % 97) / 10D + 2 AS y1) AS b")
    out = geometry.nearest_in_row(crowd.where("k % 2 = 0").withColumnsRenamed({"k": "id", "b": "lbox"}), crowd.where("k % 2 = 1").withColumnsRenamed({"k": "other", "b": "rbox"}), ["page"], "other")
    assert _joined(out) <= 4000 and out.count() == 2000
