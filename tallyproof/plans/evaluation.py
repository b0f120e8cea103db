"""Scoring of answers against a bank, checks of the bank itself, and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import to_decimal
from ..functions.text import normalize_text
from ..operators.evidence import containing
from ..session import cut

# What a bank's items may say.
TYPES, OUTCOMES, SCOPES, VERDICTS, LEVELS = ("L1", "L2", "L3", "R"), ("ANSWER", "REFUSE"), ("合并", "母公司", "跨口径", "不适用"), ("PASS", "WARN", "FAIL"), ("easy", "medium", "hard")
VALUE_FORMULAS = ("F4",)
FORMULAS = ("F1", "F2a", "F2b", "F3a", "F3b", "F4", "F5", "F6")


def _empty(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def wants_verdict() -> Column:
    """Whether an item's answer is a verdict: its formula is an identity or a heuristic."""
    return F.coalesce((F.col("question_type") == "L2") & F.col("formula").isin(*FORMULAS) & ~F.col("formula").isin(*VALUE_FORMULAS), F.lit(False))


def item_problems() -> Column:
    """array<string>: every rule that an item of a bank breaks, all of them at once."""
    q = F.coalesce("question", F.lit(""))
    parent, whole = q.rlike("(?<!归属于)母公司|本部"), q.contains("合并")
    answer = F.coalesce(F.col("expected_outcome") == "ANSWER", F.lit(False))
    verdict = wants_verdict()
    none = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    kind, scope = F.col("question_type"), F.col("scope")
    other = lambda c, v: F.coalesce(~c.isin(*v), F.lit(True))
    rules = [
        (_empty("item_id"), "item_id is empty"),
        (~_empty("item_id") & ~F.coalesce(F.col("item_id").rlike(r"^[A-Z]-[A-Z0-9_]+-[0-9]{3}$"), F.lit(False)), "item_id has a wrong form"),
        *((_empty(c), f"{c} is empty") for c in ("doc", "company", "period", "question", "track", "source")),
        (other(kind, TYPES), "question_type is unknown"),
        (other(F.col("expected_outcome"), OUTCOMES), "expected_outcome is unknown"),
        (other(scope, SCOPES), "scope is unknown"),
        (other(F.col("difficulty"), LEVELS), "difficulty is unknown"),
        (answer & parent & whole & (scope != "跨口径"), "both scopes named, scope differs"),
        (answer & parent & ~whole & (scope != "母公司"), "parent scope named, scope differs"),
        (answer & whole & ~parent & (scope != "合并"), "consolidated scope named, scope differs"),
        ((kind == "R") & (F.col("expected_outcome") != "REFUSE"), "R item must be refused"),
        ((F.col("expected_outcome") == "REFUSE") & (kind != "R"), "refused item must be R"),
        (answer & verdict & _empty("gold_verdict"), "gold_verdict is missing"),
        (answer & verdict & ~_empty("gold_verdict") & ~F.col("gold_verdict").isin(*VERDICTS), "gold_verdict is unknown"),
        (answer & verdict & none("gold_operands"), "gold_operands are missing"),
        (answer & ~verdict & _empty("gold_value"), "gold_value is missing"),
        (answer & ~_empty("gold_value") & _empty("gold_unit"), "gold_unit is missing"),
        (answer & verdict & ~_empty("gold_value"), "verdict item has a gold_value"),
        (answer & ~_empty("gold_verdict") & ~_empty("gold_value"), "both gold_verdict and gold_value"),
        (answer & none("gold_pages"), "gold_pages are missing"),
        (answer & none("gold_evidence"), "gold_evidence is missing"),
        (answer & (scope == "不适用"), "answerable item without a scope"),
        (answer & ~_empty("refusal_reason"), "answerable item has a refusal_reason"),
        (answer & ~_empty("expected_refusal_code"), "answerable item has an expected_refusal_code"),
        (answer & F.exists("gold_pages", lambda p: p < 1), "gold_pages must begin at 1"),
        (~answer & _empty("refusal_reason"), "refusal_reason is missing"),
        *((~answer & ~_empty(c), f"refused item has {c}") for c in ("gold_value", "gold_unit", "gold_verdict")),
        (~answer & ~none("gold_operands"), "refused item has gold_operands"),
        (~answer & ~(none("gold_pages") & none("gold_evidence")), "refused item has pages or evidence"),
        ((kind == "L2") & _empty("formula"), "formula is missing"),
        ((kind == "L2") & ~_empty("formula") & ~F.col("formula").isin(*FORMULAS), "formula is unknown"),
        (F.coalesce(kind != "L2", F.lit(True)) & ~_empty("formula"), "only L2 items have a formula"),
        (~none("gold_operands") & ~kind.isin("L2", "L3"), "only L2 and L3 items have gold_operands"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(m)) for r, m in rules]), lambda x: x.isNotNull())


def validate_bank(items: DataFrame, key: str = "item_id") -> DataFrame:
    """key, problems: items that break rules, repeat an id, or repeat a question of a document."""
    again = lambda *c: F.count("*").over(Window.partitionBy(*c)) > 1
    extra = F.filter(F.array(F.when(again("item_id"), F.lit("item_id is repeated")), F.when(again("doc", "question"), F.lit("question is repeated"))), lambda x: x.isNotNull())
    return items.select(key, F.concat(item_problems(), extra).alias("problems")).where(F.size("problems") > 0)


def same_number(a: Column, b: Column) -> Column:
    return F.coalesce(to_decimal(a.cast("string")) == to_decimal(b.cast("string")), F.lit(False))


def compare(items: DataFrame, results: DataFrame) -> DataFrame:
    """items joined with results (question_id = item_id; decision, reason, verdict, value, pages, operands map<string, decimal>).

    Refusals: refused, and for the expected reason if one is given; an abort isn't a
    refusal. Verdicts: operands first, then the verdict. Values: the number, then a page.
    """
    recalled = F.col("evidence_recalled") if "evidence_recalled" in results.columns else F.lit(None).cast("boolean")
    j = items.join(results.select(F.col("question_id").alias("item_id"), recalled.alias("evidence_recalled"), "route", "decision", "reason", "verdict", F.coalesce("value", "lhs").cast("string").alias("got_value"), "pages", F.col("operands").alias("got_operands"), "tool_calls", "steps"), "item_id", "left")
    refuse, verdict = F.col("expected_outcome") == "REFUSE", wants_verdict() & ~_empty("gold_verdict")
    wrong = F.map_filter(F.coalesce("gold_operands", F.create_map().cast("map<string,string>")), lambda k, v: ~same_number(F.try_element_at(F.col("got_operands"), k).cast("string"), v))
    value_ok = same_number(F.col("got_value"), F.col("gold_value"))
    page_ok = F.coalesce(F.arrays_overlap("pages", "gold_pages"), F.lit(False))
    failure = (
        F.when(refuse & (F.col("decision") == "REFUSE") & ~_empty("expected_refusal_code") & ~F.col("reason").eqNullSafe(F.col("expected_refusal_code")), "wrong_refusal_reason")
        .when(refuse & (F.col("decision") == "REFUSE"), None).when(refuse & (F.col("decision") == "ABORT"), "abort").when(refuse, "answered_but_should_refuse")
        .when(~F.col("decision").eqNullSafe("ANSWER"), "not_answered").when(verdict & (F.size(F.map_keys(wrong)) > 0), "wrong_operands")
        .when(verdict & ~F.col("verdict").eqNullSafe(F.col("gold_verdict")), "wrong_verdict").when(verdict, None).when(~value_ok, "wrong_value").when(~page_ok, "wrong_page")
    )
    out = j.withColumn("failure", failure)
    return out.select("item_id", "question_type", "scope", "expected_outcome", "route", "decision", "reason", "got_value", "failure", F.col("failure").isNull().alias("passed"), value_ok.alias("value_ok"), page_ok.alias("page_ok"), "tool_calls", "steps", "evidence_recalled")


def pass_rates(results: DataFrame) -> DataFrame:
    """(dimension, value, passed, total) over everything, by type and by scope: one pass."""
    sets = results.groupingSets([[], ["question_type"], ["scope"]], "question_type", "scope").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "question_type").otherwise("scope")
    return sets.select(dimension.alias("dimension"), F.coalesce("question_type", "scope", F.lit("all")).alias("value"), "passed", "total", F.round(F.try_divide("passed", "total"), 4).alias("rate"))


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile of an array by the nearest rank, index rounded half to even; one decimal, 0 when empty."""
    at = F.bround((F.size(values) - 1) * F.lit(p)).cast("int")
    return F.coalesce(F.round(F.get(F.sort_array(values), F.greatest(F.least(at, F.size(values) - 1), F.lit(0))), 1), F.lit(0.0))


#: Ranges into which the values that are still in question are counted in a round.
RANGES = 1024


def nearest_rank_by(df: DataFrame, by: list[str], value: str, ps: dict[str, float], ranges: int = RANGES, digits: int | None = 1) -> DataFrame:
    """The same per group, by exact selection: one row a group with a column for each of `ps`.

    Each round counts the values of a group and rank by ranges of equal width between the least
    and the greatest that the rank can be, and keeps the range that holds it, until that is one
    value. Counts are added up before any shuffle, so no task holds a group, however large; a
    round takes one pass, and two or three find a rank among any usual values.

    Null, NaN and infinite values don't count; groups without others give no row. Null group keys
    are a group.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(*by, v.alias("v"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("p"), F.bround((F.col("n") - 1) * F.lit(p)).cast("bigint").alias("left")) for k, p in ps.items()]))
    asked = cut(ends.withColumn("a", names).select(*by, "a.p", "a.left", "lo", "hi"))
    while asked.where("lo < hi").limit(1).count():
        open_ = asked.where("lo < hi").select(*[F.col(c).alias(f"of_{c}") for c in by], "p", "left", "lo", "hi")
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by], F.lit(True))
        near = rows.join(open_, same & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        # Quarters keep differences finite; the ends fall into different ranges, so every round narrows.
        share = F.coalesce(F.try_divide(F.col("v") / 4 - F.col("lo") / 4, F.col("hi") / 4 - F.col("lo") / 4), F.lit(0.0))
        part = F.when(F.col("v") == F.col("hi"), ranges - 1).otherwise(F.when(F.col("v") == F.col("lo"), 0).otherwise(F.least(F.floor(share * ranges), F.lit(ranges - 1)))).cast("int")
        counts = near.groupBy(*by, "p", "left", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*by, "p").orderBy("part"))  # at most `ranges` rows
        found = counts.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
        found = found.select(*by, "p", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "lo", "hi")
        asked = cut(asked.where("lo >= hi").unionByName(found))
    exact = F.col("lo") if digits is None else F.round("lo", digits)
    return asked.groupBy(*by).agg(*[F.max(F.when(F.col("p") == k, exact)).alias(k) for k in ps])


def usage_per_question(calls: DataFrame, run: str = "run_id", order: str = "ord") -> DataFrame:
    """Counters that add up over a run to per-question tokens; calls without a run column are of one run."""
    calls = calls if run in calls.columns else calls.withColumn(run, F.lit(0))
    w = Window.partitionBy(run).orderBy(order)
    return calls.withColumn("tokens", F.col("total_tokens") - F.coalesce(F.lag("total_tokens").over(w), F.lit(0))).withColumn("billed", F.col("tokens") > 0)


def gold_gates(items: DataFrame, index_pages: DataFrame, source_pages: DataFrame | None = None) -> DataFrame:
    """Three gates per item, each on its gold pages: its values in the index, its evidence in the index, its values in the source.

    An item's values are its operands, or else its answer; each must stand on one of the pages.
    Refusal items pass; an item without values or without evidence fails, and so does a gate
    whose pages are missing. Text is compared normalised. value_pages: pages of the document's
    index that hold the answer (or else the longest operand).
    """
    answer = items.where("expected_outcome = 'ANSWER'")
    operands = F.map_values(F.coalesce("gold_operands", F.create_map().cast("map<string,string>")))
    values = F.when(F.size(operands) > 0, operands).otherwise(F.array("gold_value"))
    probe = F.coalesce("gold_value", F.array_max(F.transform(operands, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))["v"])
    asked = lambda kind, texts: F.transform(F.filter(texts, lambda x: x.isNotNull()), lambda x: F.struct(F.lit(kind).alias("kind"), normalize_text(x).alias("needle")))
    each = F.explode(F.concat(asked("value", values), asked("evidence", F.coalesce("gold_evidence", F.array().cast("array<string>"))), asked("probe", F.array(probe))))
    needles = answer.select("item_id", F.col("doc").alias("doc_id"), "gold_pages", each.alias("e")).select("item_id", "doc_id", "gold_pages", "e.kind", "e.needle").distinct()

    def located(pages: DataFrame, name: str) -> DataFrame:
        p = pages.select("doc_id", "page", normalize_text("text").alias("plain"))
        hits = containing(p, "plain", needles, "needle", by=["doc_id"]).groupBy("item_id", "kind", "needle").agg(F.collect_set("page").alias("pages"))
        joined = needles.join(hits, ["item_id", "kind", "needle"], "left").withColumn("gold", F.coalesce(F.arrays_overlap("pages", "gold_pages"), F.lit(False)))
        gate = lambda kind: F.bool_and(F.when(F.col("kind") == kind, F.col("gold")))
        held = F.first(F.when(F.col("kind") == "probe", F.array_sort("pages")), ignorenulls=True)
        return joined.groupBy("item_id").agg(gate("value").alias(f"{name}_values"), gate("evidence").alias(f"{name}_evidence"), held.alias(f"{name}_pages"))

    out = items.join(located(index_pages, "index"), "item_id", "left")
    out = out.join(located(source_pages, "source"), "item_id", "left") if source_pages is not None else out.withColumn("source_values", F.lit(False))
    refused = F.col("expected_outcome") == "REFUSE"
    g1, g2, g3 = (F.coalesce(refused | F.col(c), refused) for c in ("index_values", "index_evidence", "source_values"))
    return out.select("item_id", g1.alias("g1"), g2.alias("g2"), g3.alias("g3"), (g1 & g2 & g3).alias("passed"), F.coalesce("index_pages", F.array().cast("array<int>")).alias("value_pages"), (F.size("index_pages") > 1).alias("ambiguous"))


def failures(results: DataFrame) -> DataFrame:
    """(failure, n), most frequent first."""
    return results.where("failure IS NOT NULL").groupBy("failure").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failure")


def eval_stats(results: DataFrame) -> DataFrame:
    """One row: totals, pass rate, answers and refusals, latency percentiles (nearest rank), tokens per billed question.

    results: compare()'s rows with latency_ms and tokens where they are measured.
    """
    for c, kind in (("latency_ms", "double"), ("tokens", "bigint"), ("evidence_recalled", "boolean")):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(None).cast(kind))
    ranks = nearest_rank_by(results.select(F.lit(0).alias("all_rows"), "latency_ms"), ["all_rows"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).first()
    at = lambda name: F.lit(float(ranks[name]) if ranks else 0.0)
    answer, refuse = F.col("expected_outcome") == "ANSWER", F.col("expected_outcome") == "REFUSE"
    recalled = F.count_if(F.coalesce(F.col("evidence_recalled"), F.lit(False)))
    return results.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.round(F.try_divide(F.count_if("passed"), F.count("*")), 4).alias("pass_rate"),
        F.count_if(answer & F.col("passed")).alias("right_answers"), F.count_if(refuse & F.col("passed")).alias("right_refusals"), F.count_if(F.coalesce(F.col("failure") == "answered_but_should_refuse", F.lit(False))).alias("false_answers"),
        F.count_if(F.coalesce(F.col("decision") == "ABORT", F.lit(False))).alias("aborts"), at("p50_ms").alias("p50_ms"), at("p95_ms").alias("p95_ms"), F.round(F.avg("tool_calls"), 2).alias("tool_calls"),
        F.round(F.avg(F.when(F.col("tokens") > 0, F.col("tokens"))), 1).alias("tokens_per_billed"), recalled.alias("evidence_recalled"),
    )


def vocabulary_ablation(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions (question_id, doc_id, question, label) -> vocabulary (with, without), hits, total: is the first lexical hit the label asked for?"""
    from ..functions.text import tokenize
    from ..operators.retrieval import bm25, postings

    out = None
    for name, words in (("with", None), ("without", ())):
        tokens = lambda c, words=words: tokenize(c) if words is None else tokenize(c, words)
        asked = questions.select("question_id", "doc_id", F.explode(tokens("question")).alias("token"))
        first = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))
        top = bm25(asked, postings(chunks, "doc_id", "chunk_id", tokens("text"))).withColumn("k", first).where("k = 1").join(chunks.select("chunk_id", F.col("label").alias("found")), "chunk_id")
        row = questions.join(top.select("question_id", "found"), "question_id", "left").agg(F.count_if(F.coalesce(F.col("found") == F.col("label"), F.lit(False))).alias("hits"), F.count("*").alias("total")).withColumn("vocabulary", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("vocabulary", "hits", "total")
