"""Accounting checks in exact decimals: a registry, and outcomes with three verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import _narrow, pct_change, quantize, safe_div, unit_scale

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"

# Id, name, kind, left side, operands with their signs.
REGISTRY = [
    ("F1", "资产 = 负债 + 所有者权益", "identity", "资产总计", [("负债合计", 1), ("所有者权益合计", 1)]),
    ("F2a", "净利润 = 利润总额 − 所得税费用", "identity", "净利润", [("利润总额", 1), ("所得税费用", -1)]),
    ("F2b", "归属于母公司股东的净利润 = 净利润 − 少数股东损益", "identity", "归属于母公司股东的净利润", [("净利润", 1), ("少数股东损益", -1)]),
    ("F3a", "现金及现金等价物净增加额 = 经营 + 投资 + 筹资 + 汇率影响", "identity", "现金及现金等价物净增加额",
     [("经营活动产生的现金流量净额", 1), ("投资活动产生的现金流量净额", 1), ("筹资活动产生的现金流量净额", 1), ("汇率变动对现金及现金等价物的影响", 1)]),
    ("F3b", "期末现金及现金等价物余额 = 期初余额 + 净增加额", "identity", "期末现金及现金等价物余额", [("期初现金及现金等价物余额", 1), ("现金及现金等价物净增加额", 1)]),
    ("F4", "毛利率 = (营业收入 − 营业成本) / 营业收入 × 100%", "derived", "毛利率", [("营业收入", 1), ("营业成本", -1)]),
    ("F5", "跨币种换算一致性", "identity", "本币列示金额", [("外币金额", 1), ("折算汇率", 1)]),
    ("F6", "同比变动合理性", "heuristic", "本期值", [("上期值", 1)]),
]
#: Formulas that are evaluated by a rule of their own; they need their operands, not a left side.
EVALUATED = {"F4": ["营业收入", "营业成本"], "F5": ["外币金额", "本币列示金额", "折算汇率"], "F6": ["本期值", "上期值"]}
YOY_THRESHOLD = 300


def registry(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """formula_id, name, kind, lhs, rhs array<struct<name, sign>>, required (operand names)."""
    rows = [(*r[:4], [{"name": n, "sign": s} for n, s in r[4]], EVALUATED.get(r[0], [r[3], *[n for n, _ in r[4]]])) for r in REGISTRY]
    schema = "formula_id string, name string, kind string, lhs string, rhs array<struct<name: string, sign: int>>, required array<string>"
    out = spark.createDataFrame(rows, schema)
    return out.where(F.col("kind") == kind) if kind else out


def tolerance(operands: Column, unit: Column) -> Column:
    """Rounding of `operands` disclosed numbers: n * 0.5 * unit."""
    return (operands.cast("decimal(9,0)") * F.lit("0.5").cast("decimal(2,1)") * unit_scale(unit)).cast("decimal(28,8)")


def suspects(operands: Column, diff: Column) -> Column:
    """array<string>: up to three operands whose magnitude, or nine times it, explains a difference within 20 %.

    operands: array<struct<name, value>>. Ordered by closeness, then name; zero operands never count.
    """
    size = F.abs(_narrow(diff))

    def score(o: Column) -> Column:
        v = F.abs(_narrow(o["value"]))
        return F.struct(F.least(safe_div(F.abs(size - v), v), safe_div(F.abs(size - v * 9), v * 9)).alias("score"), o["name"].alias("name"))

    scored = F.filter(F.transform(operands, score), lambda s: s["score"].isNotNull() & (s["score"] <= F.lit("0.2").cast("decimal(2,1)")))
    return F.when(diff == 0, F.array().cast("array<string>")).otherwise(F.transform(F.slice(F.array_sort(scored), 1, 3), lambda s: s["name"]))


def signed_sum(terms: Column) -> Column:
    """Sum of sign * value, where missing values add nothing."""
    return F.aggregate(terms, F.lit(0).cast("decimal(38,8)"), lambda a, t: (a + F.coalesce(t["value"] * t["sign"], F.lit(0))).cast("decimal(38,8)"))


def sum_identity(lhs: Column, terms: Column, tol: Column) -> Column:
    """Outcome of lhs = sum of sign * value. terms: array<struct<name, value, sign>>; a null value is missing.

    struct<verdict, lhs, rhs, diff, tolerance, missing, suspects>: WARN if anything is
    missing, PASS within the tolerance, FAIL beyond it.
    """
    missing = F.transform(F.filter(terms, lambda t: t["value"].isNull()), lambda t: t["name"])
    gap = F.size(missing) > 0
    rhs = signed_sum(terms)
    diff = (lhs - rhs).cast("decimal(38,8)")
    bad = lhs.isNull() | gap
    verdict = F.when(bad, WARN).when(F.abs(diff) <= tol, PASS).otherwise(FAIL)
    none = F.array().cast("array<string>")
    return F.struct(
        verdict.alias("verdict"), F.when(~bad, lhs.cast("decimal(38,8)")).alias("lhs"), F.when(~bad, rhs).alias("rhs"), F.when(~bad, diff).alias("diff"), tol.cast("decimal(28,8)").alias("tolerance"),
        missing.alias("missing"), F.when(verdict == FAIL, suspects(F.transform(terms, lambda t: F.struct(t["name"].alias("name"), t["value"].alias("value"))), diff)).otherwise(none).alias("suspects"),
    )


def gross_margin(revenue: Column, cost: Column, claimed: Column | None = None, tol: str = "0.01") -> Column:
    """struct<verdict, lhs, rhs, diff>: margin in percent, against a claim if there is one."""
    claimed = F.lit(None).cast("decimal(18,2)") if claimed is None else claimed
    value = quantize(safe_div(_narrow(revenue) - _narrow(cost), revenue) * 100)
    diff = value - claimed
    verdict = F.when(value.isNull(), WARN).when(claimed.isNull(), PASS).when(F.abs(diff) <= F.lit(tol).cast("decimal(10,4)"), PASS).otherwise(FAIL)
    return F.struct(verdict.alias("verdict"), value.alias("lhs"), claimed.alias("rhs"), diff.alias("diff"))


def cross_currency(foreign: Column, local: Column, rate: Column, tol: Column | None = None) -> Column:
    """struct<verdict, lhs, rhs, diff, tolerance>; default tolerance 0.5 % of the local amount, half even to cents."""
    value = quantize((foreign.cast("decimal(20,4)") * rate.cast("decimal(12,6)")).cast("decimal(32,10)"))
    tol = F.bround(F.abs(local).cast("decimal(24,4)") * F.lit("0.005").cast("decimal(4,3)"), 2) if tol is None else tol
    diff = (value - local).cast("decimal(28,8)")
    return F.struct(F.when(F.abs(diff) <= tol, PASS).otherwise(FAIL).alias("verdict"), value.alias("lhs"), local.alias("rhs"), diff.alias("diff"), tol.alias("tolerance"))


def yoy(current: Column, prior: Column, threshold: int = YOY_THRESHOLD) -> Column:
    """struct<verdict, change, reasons>: WARN on a base that isn't positive, a change over the threshold or a change of sign; never FAIL."""
    change = pct_change(current, prior)
    flipped = (current < 0) != (prior < 0)
    reasons = F.filter(
        F.array(F.when(change.isNull(), F.lit("base_not_positive")), F.when(F.abs(change) > threshold, F.lit("over_threshold")), F.when(change.isNotNull() & flipped, F.lit("sign_flipped"))), lambda r: r.isNotNull()
    )
    return F.struct(F.when(F.size(reasons) > 0, WARN).otherwise(PASS).alias("verdict"), change.alias("change"), reasons.alias("reasons"))


def evaluate(operands: DataFrame, key: list[str], unit: str = "unit") -> DataFrame:
    """Outcomes of many formulas at once. operands: (key…, formula_id, name, value, unit), value null if missing.

    Operands that a formula doesn't need are ignored; an unknown formula_id gives
    FORMULA_NOT_FOUND. A name that comes more than once counts once where its values agree (nulls
    aside), else the outcome's error is CONFLICTING_OPERANDS and it counts as missing; rows without
    a name only say that the formula is asked for. Dealt by key and formula once: what is aggregated
    by name stays in its order for what is aggregated by key and formula; the registry is eight rows.
    """
    spark = operands.sparkSession
    value = F.col("value").cast("decimal(28,8)")
    dealt = operands.repartition(*key, "formula_id")
    named = dealt.groupBy(*key, "formula_id", "name").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.min(unit).alias("u"))
    agreed = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    entry = F.when(F.col("name").isNotNull(), F.struct("name", agreed.alias("v")))
    conflict = F.coalesce(F.bool_or(F.col("name").isNotNull() & (F.col("lo") < F.col("hi"))), F.lit(False))
    # Values by their place among the formula's operands: these need no lists, which are only made where `operands` is asked for.
    needed = {r[0]: EVALUATED.get(r[0], [r[3], *[n for n, _ in r[4]]]) for r in REGISTRY}
    place = F.coalesce(*[F.when(F.col("formula_id") == f, F.array_position(F.array(*map(F.lit, names)), F.col("name"))) for f, names in needed.items()])
    values = F.array(*[F.max(F.when(F.col("place") == i + 1, agreed)) for i in range(max(map(len, needed.values())))])
    grouped = named.withColumn("place", place).groupBy(*key, "formula_id").agg(values.alias("values"), F.map_from_entries(F.collect_list(entry)).alias("m"), F.min("u").alias("unit"), conflict.alias("conflict"))
    known = grouped.join(F.broadcast(registry(spark).withColumnsRenamed({"lhs": "left_name", "rhs": "terms"})), "formula_id", "left")
    at = lambda n: F.get("values", F.array_position("required", F.lit(n) if isinstance(n, str) else n) - 1)
    # Each is a column of its own, so that none is computed again wherever it is read.
    known = known.withColumn("left", at(F.col("left_name"))).withColumn("terms", F.transform("terms", lambda r: F.struct(r["name"].alias("name"), at(r["name"]).alias("value"), r["sign"].alias("sign"))))
    known = known.withColumn("missing", F.filter("required", lambda n: at(n).isNull())).withColumn("tol", tolerance(F.size("terms") + 1, F.col("unit"))).withColumn("right", signed_sum(F.col("terms")))
    known = known.withColumn("gap", (F.col("left") - F.col("right")).cast("decimal(38,8)"))
    missing, tol, gap = F.col("missing"), F.col("tol"), F.col("gap")
    near = F.abs(gap) <= tol
    margin, fx, change = gross_margin(at("营业收入"), at("营业成本")), cross_currency(at("外币金额"), at("本币列示金额"), at("折算汇率")), yoy(at("本期值"), at("上期值"))
    wide = lambda c: c.cast("decimal(38,8)")
    fid = F.col("formula_id")
    pick = lambda a, b, c, d: F.when(fid == "F4", wide(a)).when(fid == "F5", wide(b)).when(fid == "F6", wide(c)).otherwise(wide(d))
    none = F.lit(None).cast("decimal(38,8)")
    verdict = F.when(F.col("name").isNull(), None).when(F.size(missing) > 0, WARN).when(fid == "F4", margin["verdict"]).when(fid == "F5", fx["verdict"]).when(fid == "F6", change["verdict"]).when(near, PASS).otherwise(FAIL)
    whole = F.col("verdict").isin(PASS, FAIL) | ((fid.isin("F4", "F5", "F6")) & (F.size("missing") == 0))
    no_names = F.array().cast("array<string>")
    doubtful = F.when(~near, suspects(F.transform("terms", lambda t: F.struct(t["name"].alias("name"), t["value"].alias("value"))), gap)).otherwise(no_names)
    out = known.withColumn("verdict", verdict)
    return out.select(
        *key, "formula_id", "name", "kind", "verdict",
        F.when(whole, pick(margin["lhs"], fx["lhs"], at("本期值"), F.col("left"))).alias("lhs"), F.when(whole, pick(none, fx["rhs"], at("上期值"), F.col("right"))).alias("rhs"),
        F.when(whole, pick(none, fx["diff"], change["change"], gap)).alias("diff"), pick(F.lit("0.01"), fx["tolerance"], F.lit(YOY_THRESHOLD), tol).alias("tolerance"),
        "missing", F.when(F.col("verdict") == FAIL, doubtful).otherwise(no_names).alias("suspects"),
        F.when(F.col("name").isNull(), "FORMULA_NOT_FOUND").when(F.col("conflict"), "CONFLICTING_OPERANDS").when(F.size("missing") > 0, "MISSING_OPERANDS").alias("error"), F.col("m").alias("operands"),
    )
