"""Text, amounts and question rewriting: literal cases and round trips."""

import unicodedata
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyproof.functions import amounts, lexicon, rewrite, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("x")).first().x


def many(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", column.alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


@pytest.mark.parametrize("given_text,want", [
    ("1,234.56", [("1234.56", None, "1234.56")]), ("1.23亿元", [("1.23", "亿元", "123000000")]), ("1,234万元", [("1234", "万元", "12340000")]), ("5百万元", [("5", "百万元", "5000000")]), ("(1,234.56)", [("-1234.56", None, "-1234.56")]),
    ("（1,234.56）后 7", [("-1234.56", None, "-1234.56"), ("7", None, "7")]), ("营业收入 100 万元 营业成本 60 万元", [("100", "万元", "1000000"), ("60", "万元", "600000")]), ("１２，３４５．６７", [("12345.67", None, "12345.67")]), ("无", []), (None, []), ("3千 4亿", [("3", "千", "3000"), ("4", "亿", "400000000")]),
])
def test_parse_amounts(spark, given_text, want):
    got = one(spark, given_text, amounts.parse_amounts("s"))
    assert [(a.value, a.unit, a.normalized) for a in got] == [(Decimal(v), u, Decimal(n)) for v, u, n in want]
    assert all(a.unit_assumed == (a.unit is None) for a in got)


def test_dates_count_as_amounts(spark):
    assert Decimal(2023) in [a.value for a in one(spark, "2023-12-31", amounts.parse_amounts("s"))]


def test_single_amount(spark):
    got = many(spark, ["1.234567万元", "1 2", "x"], amounts.single_amount("s"))
    assert got[0].normalized == Decimal("12345.67") and got[1] is None and got[2] is None


@given(st.lists(st.decimals(min_value=-10**12, max_value=10**12, places=2), min_size=1, max_size=30))
@settings(max_examples=10, deadline=None)
def test_amounts_round_trip(spark, values):
    got = many(spark, [f"a {v:,} b" for v in values], amounts.single_amount("s"))
    assert [g.value for g in got] == values


def test_to_decimal_takes_plain_numbers_only(spark):
    assert many(spark, ["1,234", " 5.5 ", "1E5", "NaN", "", None, "-3", "１"], amounts.to_decimal("s")) == [Decimal(1234), Decimal("5.5"), None, None, None, None, Decimal(-3), None]


def test_units(spark):
    assert many(spark, ["元", "千元", "万元", "百万元", "亿元", "吨", None], amounts.unit_scale("s")) == [1, 1000, 10**4, 10**6, 10**8, 1, 1]
    assert many(spark, ["元", "万", "", None], amounts.is_known_unit("s")) == [True, False, False, False]


@pytest.mark.parametrize("cur,prior,plain,signed", [("120", "100", "20.00", "20.00"), ("50", "-100", None, "150.00"), ("5", "0", None, None), ("-50", "100", "-150.00", "-150.00"), ("1", "3", "-66.67", "-66.67")])
def test_changes(spark, cur, prior, plain, signed):
    d = lambda v: F.lit(v).cast("decimal(28,8)")
    r = spark.range(1).select(amounts.pct_change(d(cur), d(prior)).alias("p"), amounts.signed_pct_change(d(cur), d(prior)).alias("s"), amounts.safe_div(d("1"), d("0")).alias("z"), amounts.quantize(d("-91.925")).alias("q")).first()
    assert (r.p, r.s) == (plain and Decimal(plain), signed and Decimal(signed)) and r.z is None and r.q == Decimal("-91.93")


def test_normalize_text_equals_nfkc_on_single_forms(spark):
    cases = ["ＡＢＣ　１２３", "a b　c\n", "—–−－", "“q”‘r’「s」", "①②", "㎡", None, "é ñ"]
    want = []
    for c in cases:
        x = unicodedata.normalize("NFKC", c or "")
        x = "".join(ch for ch in x if not ch.isspace())
        for d in "‐‑‒–—−－":
            x = x.replace(d, "-")
        for a, b in zip("‘’“”「」『』", "''\"\"\"\"\"\""):
            x = x.replace(a, b)
        want.append(x)
    assert many(spark, cases, text.normalize_text("s", exact=True)) == want
    fast = many(spark, cases, text.normalize_text("s"))
    assert [f for f, c in zip(fast, cases) if c != "㎡"] == [w for w, c in zip(want, cases) if c != "㎡"]


@pytest.mark.parametrize("label,want", [("一、营业总收入", "营业总收入"), ("其中:营业收入", "营业收入"), ("加：营业外收入", "营业外收入"), ("减:营业外支出", "营业外支出"), ('净利润（净亏损以"-"号填列）', "净利润"), ("（1）其中:利息收入", "利息收入"), ("所有者权益（或股东权益）合计", "所有者权益（或股东权益）合计"), (None, "")])
def test_clean_label(spark, label, want):
    assert one(spark, label, text.clean_label("s")) == want


def test_tokens(spark):
    assert one(spark, "请问2024年营业收入是多少", text.tokenize("s")) == ["2024", "年", "营业收入"]
    assert one(spark, "营业外收入、非流动负债合计", text.tokenize("s")) == ["营业外收入", "非流动负债合计"]
    assert one(spark, "的是多少", text.tokenize("s")) == [] and one(spark, None, text.tokenize("s")) == []
    assert set(many(spark, lexicon.FINANCIAL_TERMS, F.size(text.tokenize("s")))) == {1}


def test_cells(spark):
    assert many(spark, ["1,234", "12.50", "12345", "39", "-1,000.00", "项目", "", "-12"], text.looks_like_amount("s")) == [True, True, True, False, True, False, False, False]
    assert many(spark, ["2024年12月31日", "2024-1-2", "2024 年 1 月 5 日", "2024年"], text.looks_like_date("s")) == [True, True, True, False]
    assert one(spark, "2024 与 1999、12024", text.years_in("s")) == [1999, 2024]


def test_fragment(spark):
    t = "货币资金 | 流动资产: | 59,295.89 | 69,070.12"
    f = lambda v: spark.createDataFrame([(t, v)], "t string, v string").select(text.fragment("t", "v").alias("x")).first().x
    assert f("59,295.89") == "流动资产: | 59,295.89" and f("77") == "77" and f("69,070.12") in t


def test_company_and_question(spark):
    assert one(spark, "贵州茅台酒股份有限公司", text.company_aliases("s")) == ["贵州茅台酒股份有限公司", "贵州茅台酒", "贵州茅台"]
    assert many(spark, ["  ", None, "好", "长" * 201], text.question_error("s")) == ["empty", "empty", None, "too long"]


@pytest.mark.parametrize("q,want", [
    ("2024年经营现金流是多少", "2024年经营活动产生的现金流量净额是多少"), ("投资活动现金流", "投资活动产生的现金流量净额"), ("经营现金流量净额", "经营活动产生的现金流量净额"), ("归母净利", "归属于母公司股东的净利润"),
    ("投资活动现金流入小计是多少", "投资活动现金流入小计是多少"), ("经营活动产生的现金流量净额", "经营活动产生的现金流量净额"), ("现金流量表", "现金流量表"), ("", ""), (None, ""),
])
def test_expand(spark, q, want):
    assert one(spark, q, rewrite.expand_question("s")) == want


def test_ambiguous(spark):
    got = many(spark, ["2024年现金流是多少", "营收和净资产、营收", "经营现金流", "经营活动产生的现金流量净额", "合并现金流量表的货币资金"], rewrite.ambiguous_names("s"))
    assert [[a.key for a in x] for x in got] == [["现金流"], ["营收", "净资产"], [], [], []]
    assert one(spark, "营收和净资产", rewrite.longest_ambiguous("s")).key == "净资产" and len(got[0][0].options) == 3


def test_scope(spark):
    qs = ["合并报表的货币资金", "母公司的货币资金", "归属于母公司股东的净利润", "合并与母公司口径", "本部货币资金", "货币资金"]
    assert many(spark, qs, rewrite.question_scope("s")) == ["合并", "母公司", None, None, "母公司", None]
    assert many(spark, qs, rewrite.both_scopes("s")) == [False, False, False, True, False, False]
    assert many(spark, ["合并资产负债表", "母公司利润表", "附注", None], rewrite.caption_scope("s")) == ["合并", "母公司", None, None]


def labels():
    return F.array(*[F.lit(x) for x in ("净利润", "归属于母公司股东的净利润", "资产总计", "负债合计", "非流动负债合计")])


def test_routes(spark):
    qs = ["资产总计是否等于负债合计与所有者权益合计之和", "净利润是否等于利润总额减去所得税费用", "毛利率是多少", "同比增长", "归母净利润与净利润相差多少", "资产总计与负债合计的差额", "资产总计是多少", "报表平衡吗", "净利润的差额"]
    operands = rewrite.difference_operands(F.col("s"), labels())
    assert many(spark, qs, rewrite.route(F.col("s"), operands)) == ["VERIFY", "VERIFY", "VERIFY", "VERIFY", "DIFF", "DIFF", "LOOKUP", "VERIFY", "LOOKUP"]
    assert many(spark, qs, rewrite.check_formula("s"))[:4] == ["F1", "F2a", "F4", "F6"]
    got = one(spark, "合并口径的资产总计与母公司口径的资产总计相差多少", operands)
    assert [(o.label, o.scope) for o in got] == [("资产总计", "合并"), ("资产总计", "母公司")]
    assert one(spark, "归母净利润是多少", rewrite.best_label(F.col("s"), labels())) == "归属于母公司股东的净利润"
    assert one(spark, "非流动负债合计", rewrite.best_label(F.col("s"), labels())) == "非流动负债合计"
