"""Batches of questions to verified answers or refusals.

Three routes (LOOKUP, VERIFY, DIFF) are evaluated as sets and meet in one ordered
decision. The loop of a step-by-step agent becomes ranks: candidates are all evaluated, the
first usable one counts, and its rank tells the tool calls and steps that a loop would take.

Tables: questions (question_id, doc_id, question[, period]); documents (doc_id, company,
unit, years array<int>); chunks with the index made from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import to_decimal
from ..functions.lexicon import OTHER_ISSUERS
from ..functions.rewrite import check_formula, difference_operands, longest_ambiguous, question_scope, route
from ..functions.text import company_aliases, fragment, label_key, question_error
from ..operators import evidence, formulas, retrieval
from ..session import cut

#: Most steps, tool calls and questions to a model in a run.
BUDGETS = {"steps": 12, "tool_calls": 10}
#: Nodes of the run graph, their successors in order.
GRAPH = {
    "GUARD": ["SEARCH", "LIST_FORMULAS", "DIFF", "REFUSE"], "SEARCH": ["EVIDENCE", "REFUSE"], "EVIDENCE": ["VERIFY_SPAN", "EVIDENCE", "REFUSE"], "VERIFY_SPAN": ["LOCATE", "REFUSE"],
    "LOCATE": ["ANSWER", "REFUSE"], "LIST_FORMULAS": ["COMPUTE", "REFUSE"], "COMPUTE": ["ANSWER", "REFUSE"], "DIFF": ["ANSWER", "REFUSE"], "ANSWER": [], "REFUSE": [], "ABORT": [],
}


def prepare(questions: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions with their document's facts, scope, operands, route and every refusal that needs no retrieval."""
    labels = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("labels")).withColumn("label_keys", F.array_distinct(F.transform("labels", label_key)))
    q = questions.withColumn("question", F.trim("question"))
    if "period" not in q.columns:
        q = q.withColumn("period", F.lit("current"))
    q = q.join(documents, "doc_id", "left").join(labels, "doc_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("labels", "label_keys")})
    q = q.withColumn("scope", question_scope("question")).withColumn("operands", difference_operands(F.col("question"), F.col("labels")))
    q = q.withColumn("route", route(F.col("question"), F.col("operands"))).withColumn("formula_id", F.when(F.col("route") == "VERIFY", check_formula("question")))
    q = q.withColumn("input_error", question_error("question"))
    issuers = F.array(*map(F.lit, OTHER_ISSUERS))
    years = F.coalesce("years", F.array().cast("array<int>"))
    guard = F.when(longest_ambiguous("question").isNotNull(), "AMBIGUOUS_ABBREVIATION").otherwise(evidence.constraint_error(F.col("question"), F.coalesce("company", F.lit("")), company_aliases("company"), issuers, years))
    return q.withColumn("guard", guard)


def period_column(period: Column) -> Column:
    return F.when(period == "current", 0).otherwise(1)


def row_evidence(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """wanted (…, doc_id, label, scope, period) -> error, printed, value, raw, page, row_scope, chunk_text, fragment."""
    out = evidence.resolve_rows(wanted, chunks)
    raw = F.get("row.values", period_column(F.col("period")))
    value = to_decimal(raw)
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(raw.isNull(), "COLUMN_MISSING").when(value.isNull(), "VALUE_UNPARSED")
    return out.select(
        *wanted.columns, error.alias("error"), "printed", F.when(error.isNull(), value).alias("value"), F.when(error.isNull(), raw).alias("raw"), F.col("row.page").alias("page"),
        F.col("row.scope").alias("row_scope"), F.col("row.text").alias("chunk_text"), F.when(error.isNull(), fragment(F.col("row.text"), raw)).alias("fragment"),
    )


#: What the routes ask of rows: whose, for what (a candidate's rank, an operand's name, a side), and which row.
WANTED = ("route", "question_id", "ord", "name", "formula_id", "unit", "doc_id", "label", "scope", "period")


def wanted_rows(prepared: DataFrame, index: dict[str, DataFrame], top_k: int = 5) -> DataFrame:
    """The rows that all questions need, whatever their route, in one table of the columns WANTED."""
    open_ = prepared.where("guard IS NULL AND input_error IS NULL")
    asked = open_.where("route = 'LOOKUP'")
    hits = retrieval.retrieve(asked.select("question_id", "doc_id", "question"), index, top_k)
    cand = hits.select("question_id", "chunk_id", F.col("rank").alias("ord")).join(index["chunks"].select("chunk_id", "label"), "chunk_id").join(asked.select("question_id", "doc_id", "scope", "period", "route", "formula_id", "unit"), "question_id")
    need = formulas.registry(prepared.sparkSession).select("formula_id", F.explode("required").alias("name"))
    operands = open_.where("route = 'VERIFY'").join(F.broadcast(need), "formula_id").withColumn("label", F.col("name")).withColumn("ord", F.lit(0))
    sides = open_.where("route = 'DIFF'").select("*", F.posexplode("operands").alias("ord", "o")).withColumns({"label": F.col("o.label"), "scope": F.col("o.scope")})
    none = F.lit(None).cast("string")
    return cand.withColumn("name", none).select(*WANTED).unionByName(operands.select(*WANTED)).unionByName(sides.withColumn("name", none).select(*WANTED))


def lookup(prepared: DataFrame, rows: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """LOOKUP questions -> question_id, error, evidence columns, span verdict, rank of the candidate used.

    rows: row_evidence() of wanted_rows().

    boxes: (question_id, same_row, row_box) where a page geometry is at hand; a row that
    isn't verified leaves the answer without a box, as a missing geometry does.
    """
    asked = prepared.where("route = 'LOOKUP' AND guard IS NULL AND input_error IS NULL")
    found = rows.where("route = 'LOOKUP'").withColumnRenamed("ord", "rank")
    # The first candidate's scope error is final; else the first usable candidate counts.
    usable = F.when(F.col("error").isNull() | ((F.col("error") == "AMBIGUOUS_SCOPE") & (F.col("rank") == 1)), F.col("rank"))
    pack = F.struct("rank", "error", "printed", "value", "raw", "page", "row_scope", "chunk_text", "fragment")
    best = found.groupBy("question_id").agg(F.coalesce(F.min_by(pack, usable), F.max_by(pack, F.col("rank"))).alias("e"), F.max("rank").alias("tried"), F.min(usable).alias("used"))
    out = asked.select("question_id", "question", "labels", "label_keys", "unit").join(best, "question_id", "left")
    # Values and text come from one row, so the proof is of the printed number itself.
    span = F.when(F.col("e.error").isNull() & F.col("e").isNotNull(), evidence.verify_evidence(F.col("e.fragment"), F.col("e.chunk_text"), F.col("e.value"), F.lit(None).cast("string")))
    out = out.withColumn("span", span).withColumn("label_error", evidence.label_error(F.col("question"), F.col("e.printed"), F.col("labels"), F.col("label_keys")))
    error = (
        F.when(F.col("e").isNull(), "NO_RECALL").when(F.col("e.error").isNotNull(), F.col("e.error")).when(~F.col("span.accepted"), F.coalesce("span.reason", F.lit("SPAN_REJECTED")))
        .when(F.col("label_error").isNotNull(), "LABEL_MISMATCH")
    )
    calls = F.lit(2) + F.coalesce(F.col("used"), F.col("tried"), F.lit(0)) + F.when(F.col("used").isNotNull() & F.col("e.error").isNull(), 2).otherwise(0)
    out = out.select("question_id", error.alias("error"), F.col("e.printed").alias("indicator"), F.col("e.value").alias("value"), F.col("e.raw").alias("raw"), F.array("e.page").alias("pages"), F.col("e.row_scope").alias("row_scope"), F.col("e.fragment").alias("fragment"), F.col("span.mode").alias("span_mode"), calls.alias("tool_calls"))
    if boxes is None:
        return out.withColumn("row_box", F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>"))
    return out.join(boxes.select("question_id", F.when(F.col("same_row"), F.col("row_box")).alias("row_box")), "question_id", "left")


def verify(rows: DataFrame) -> DataFrame:
    """VERIFY questions -> question_id, error, outcome columns, operands, pages."""
    found = rows.where("route = 'VERIFY'")
    outcome = formulas.evaluate(found, ["question_id"]).drop("error")
    scope_error = F.max(F.when(F.col("error").isin("AMBIGUOUS_SCOPE", "SCOPE_NOT_AVAILABLE"), F.col("error"))).alias("scope_error")
    side = found.groupBy("question_id").agg(scope_error, F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), F.col("page")))).alias("pages"))
    out = outcome.join(side, "question_id")
    error = F.when(F.col("scope_error").isNotNull(), F.col("scope_error")).when(F.size("missing") > 0, "MISSING_OPERANDS").when(F.col("verdict").isNull(), "NO_OUTCOME")
    return out.select("question_id", error.alias("error"), "verdict", "lhs", "rhs", "diff", "tolerance", "missing", "suspects", F.col("operands"), "pages", F.lit(3).alias("tool_calls"))


def difference(rows: DataFrame) -> DataFrame:
    """DIFF questions -> question_id, error, indicator, value = |a - b|, pages."""
    found = rows.where("route = 'DIFF'").withColumnRenamed("ord", "side")
    at = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    shown = F.when(F.col("scope").isNotNull(), F.concat(F.col("printed"), F.lit("（"), F.col("scope"), F.lit("）"))).otherwise(F.col("printed"))
    out = found.withColumn("shown", shown).groupBy("question_id").agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("side"))).alias("error"), F.abs(at(0, "value") - at(1, "value")).alias("value"),
        F.concat(at(0, "shown"), F.lit(" − "), at(1, "shown")).alias("indicator"), F.array_sort(F.collect_set("page")).alias("pages"),
    )
    error = F.when(F.col("error") == "VALUE_UNPARSED", "NON_NUMERIC").otherwise(F.col("error"))
    return out.select("question_id", error.alias("error"), "indicator", "value", "pages", F.lit(2).alias("tool_calls"))


def answer(questions: DataFrame, documents: DataFrame, index: dict[str, DataFrame], top_k: int = 5, budgets: dict[str, int] = BUDGETS, boxes: DataFrame | None = None) -> DataFrame:
    """One row per question: route, decision (ANSWER, REFUSE, ABORT, or null on an input error), reason, the six-tuple and the outcome."""
    chunks = index["chunks"]
    # Questions, the rows they want and what these hold are computed once each; plans stay small.
    prepared = cut(prepare(questions, documents, chunks))
    rows = cut(row_evidence(cut(wanted_rows(prepared, index, top_k)), chunks))
    a, b, c = lookup(prepared, rows, boxes), verify(rows), difference(rows)
    common = lambda df, *more: df.select("question_id", F.col("error"), F.col("pages"), "tool_calls", *more)
    merged = common(a, "indicator", "value", "row_scope", "fragment", "span_mode", "row_box").unionByName(common(c, "indicator", "value"), allowMissingColumns=True)
    merged = merged.unionByName(common(b, "verdict", "lhs", "rhs", F.col("diff"), "tolerance", "missing", "suspects", "operands"), allowMissingColumns=True)
    q = prepared.select("question_id", "doc_id", "question", F.col("period").alias("asked_period"), "route", "formula_id", "scope", "company", "unit", "years", "guard", "input_error")
    out = q.join(merged, "question_id", "left")
    calls = F.when(F.col("guard") == "AMBIGUOUS_ABBREVIATION", 0).when(F.col("guard").isNotNull(), 1).otherwise(F.coalesce("tool_calls", F.lit(1)))
    steps = F.when(calls == 0, 0).otherwise(calls + 1)
    # The prior period is the last but one of the document's years, or the year before its only one.
    prior = F.coalesce(F.get(F.sort_array("years", False), F.lit(1)), F.array_max("years") - 1)
    year = F.when(period_column(F.col("asked_period")) == 0, F.array_max("years")).otherwise(prior)
    period = F.when(F.size("years") > 0, F.concat(year.cast("string"), F.lit(" 年度")))
    meta = F.when(F.col("route") != "VERIFY", evidence.missing_fields(company=F.col("company"), period=period)).otherwise(F.array().cast("array<string>"))
    over = (steps > budgets["steps"]) | (calls > budgets["tool_calls"])
    nothing = F.when(F.col("route") == "VERIFY", "NO_OUTCOME").when(F.col("route") == "DIFF", "DIFF_FAILED").otherwise("NO_RECALL")
    reason = (
        F.when(F.col("guard").isNotNull(), F.col("guard")).when(over, "BUDGET_EXCEEDED").when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("verdict").isNull() & F.col("value").isNull(), nothing).when(F.size(meta) > 0, "SIX_TUPLE_INCOMPLETE")
    )
    decision = F.when(F.col("input_error").isNotNull(), None).when(reason == "BUDGET_EXCEEDED", "ABORT").when(reason.isNotNull(), "REFUSE").otherwise("ANSWER")
    given = lambda x: F.when(decision == "ANSWER", x)
    return out.select(
        "question_id", "doc_id", "question", "route", "formula_id", decision.alias("decision"), F.when(F.col("input_error").isNull(), reason).alias("reason"), "input_error",
        given(F.col("company")).alias("company"), given(period).alias("period"), given(F.col("indicator")).alias("indicator"),
        given(F.coalesce("row_scope", "scope", F.lit("未标注"))).alias("scope"), given(F.col("value")).alias("value"), given(F.col("unit")).alias("unit"), given(F.col("pages")).alias("pages"),
        "fragment", "span_mode", given(F.col("row_box")).alias("row_box"), given(F.col("verdict")).alias("verdict"), given(F.col("lhs")).alias("lhs"), given(F.col("rhs")).alias("rhs"), given(F.col("diff")).alias("diff"),
        given(F.col("tolerance")).alias("tolerance"), "missing", "suspects", "operands", calls.alias("tool_calls"), steps.alias("steps"), (F.col("guard").isNull() & (calls > 1)).alias("evidence_recalled"),
    )


def reverse_lookup(values: DataFrame, index: dict[str, DataFrame], limit: int = 20) -> DataFrame:
    """values (question_id, doc_id, question holding a number) -> the rows that print it, without the label guard."""
    hits = retrieval.numeric_channel(values, index["numbers"], limit)
    return hits.join(index["chunks"], "chunk_id").select("question_id", "rank", "chunk_id", "label", "scope", "page", "text")
