"""The engine's tools over tables of requests: each takes requests with a request_id and gives one row per request.

A failed request has an `error` and nulls; it is never an exception.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.amounts import to_decimal
from ..functions.lexicon import OTHER_ISSUERS
from ..functions.text import company_aliases
from ..operators import evidence, formulas, geometry, retrieval
from .answer import row_evidence

#: What each tool takes, by name: (required arguments, optional ones); all tools take request_id and doc_id besides.
SPECS = {
    "check_constraints": (("question",), ()), "search_statement": (("query",), ()), "get_row_evidence": (("label",), ("scope", "period")), "locate_rows": (("page", "label", "value"), ()),
    "verify_span": (("label", "claimed_span", "claimed_value"), ("scope",)), "list_formulas": ((), ("kind",)), "compute": (("formula_id",), ("scope", "period")), "diff_two_rows": (("label_a", "label_b"), ("scope_a", "scope_b", "period")),
}


def tool_schema(name: str) -> dict:
    """A tool's arguments as a JSON schema of an object."""
    required, optional = SPECS[name]
    kinds = {"page": {"type": "integer"}, "period": {"type": "string", "enum": ["current", "prior"]}}
    return {"type": "object", "properties": {a: kinds.get(a, {"type": "string"}) for a in (*required, *optional)}, "required": list(required), "additionalProperties": False}


def check_constraints(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """requests (request_id, doc_id, question) -> error: OUT_OF_DOCUMENT_PERIOD, WRONG_DOCUMENT or null."""
    j = requests.join(documents, "doc_id", "left")
    years = F.coalesce("years", F.array().cast("array<int>"))
    error = evidence.constraint_error(F.col("question"), F.coalesce("company", F.lit("")), company_aliases("company"), F.array(*map(F.lit, OTHER_ISSUERS)), years)
    return j.select("request_id", error.alias("error"))


def _search_labels(requests: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """Without an index: primary rows whose label contains the query or is contained in it, in document order."""
    rows = evidence.by_label(chunks).select("doc_id", "chunk_id", "label", "scope", "page", "text", "table_index", "row_index")
    named = requests.where(F.col("query") != "").join(rows, "doc_id").where(F.call_function("contains", F.col("label"), F.col("query")) | F.call_function("contains", F.col("query"), F.col("label")))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("table_index", "row_index", "chunk_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= top_k).select("request_id", "chunk_id", F.array(F.lit("label")).alias("via"), "rank", "label", "scope", "page", "text")


def search_statement(requests: DataFrame, index: dict[str, DataFrame], top_k: int = 5) -> DataFrame:
    """requests (request_id, doc_id, query) -> hits by rank; a request without any gives one row with NO_RECALL.

    An index of chunks alone is searched by labels; its hits say so in `degraded`.
    """
    if "postings" not in index:
        out = requests.select("request_id").join(_search_labels(requests, index["chunks"], top_k), "request_id", "left")
        return out.withColumn("error", F.when(F.col("chunk_id").isNull(), "NO_RECALL")).withColumn("degraded", F.when(F.col("chunk_id").isNotNull(), "no_index"))
    asked = requests.select(F.col("request_id").alias("question_id"), "doc_id", F.col("query").alias("question"))
    hits = retrieval.retrieve(asked, index, top_k).withColumnRenamed("question_id", "request_id")
    shown = hits.join(index["chunks"].select("chunk_id", "label", "scope", "page", "text"), "chunk_id")
    out = requests.select("request_id").join(shown, "request_id", "left")
    return out.withColumn("error", F.when(F.col("chunk_id").isNull(), "NO_RECALL"))


def get_row_evidence(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests (request_id, doc_id, label, scope, period) -> value, page, fragment or LABEL_NOT_FOUND, AMBIGUOUS_SCOPE, SCOPE_NOT_AVAILABLE, COLUMN_MISSING, VALUE_UNPARSED."""
    return row_evidence(requests.select("request_id", "doc_id", "label", "scope", "period"), chunks)


def verify_span(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests (request_id, doc_id, label, scope, claimed_span, claimed_value) -> accepted, reason, mode."""
    keys = requests.select("request_id", "doc_id", "label", "scope", "claimed_span", "claimed_value")
    found = evidence.resolve_rows(keys, chunks)
    value = to_decimal("claimed_value")
    v = evidence.verify_evidence(F.col("claimed_span"), F.col("row.text"), value, F.lit(None).cast("string"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(value.isNull(), "VALUE_UNPARSED")
    return found.withColumn("v", v).select("request_id", error.alias("error"), F.when(error.isNull(), F.col("v.accepted")).alias("accepted"), F.when(error.isNull(), F.col("v.reason")).alias("reason"), F.when(error.isNull(), F.col("v.mode")).alias("mode"))


def list_formulas(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """The registry's formulas of a kind with a null error; one row with NO_FORMULA if there is none."""
    found = formulas.registry(spark, kind).withColumn("one", F.lit(1))
    out = spark.range(1).select(F.lit("NO_FORMULA").alias("none")).join(found, F.lit(True), "left")
    return out.withColumn("error", F.when(F.col("one").isNull(), F.col("none"))).drop("one", "none")


def compute(requests: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """requests (request_id, doc_id, formula_id, scope, period) -> outcome, or FORMULA_NOT_FOUND, MISSING_OPERANDS, a scope's error."""
    need = formulas.registry(requests.sparkSession).select("formula_id", F.explode("required").alias("name"))
    asked = requests.join(F.broadcast(need), "formula_id", "left").join(documents.select("doc_id", "unit"), "doc_id", "left")
    wanted = asked.select("request_id", "doc_id", "formula_id", "scope", "period", "unit", "name", F.coalesce("name", F.lit("")).alias("label"))
    found = row_evidence(wanted, chunks)
    scope_error = F.max(F.when(F.col("error").isin("AMBIGUOUS_SCOPE", "SCOPE_NOT_AVAILABLE"), F.col("error"))).alias("scope_error")
    side = found.groupBy("request_id").agg(scope_error, F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), F.col("page")))).alias("pages"))
    out = formulas.evaluate(found.withColumn("name", F.coalesce("name", F.lit(""))), ["request_id"]).join(side, "request_id")
    return out.withColumn("error", F.coalesce(F.when(F.col("name").isNotNull(), F.col("scope_error")), "error")).drop("scope_error")


def diff_two_rows(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests (request_id, doc_id, label_a, scope_a, label_b, scope_b, period) -> value = |a - b|, pages, or a side's error."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"label_{s}").alias("label"), F.col(f"scope_{s}").alias("scope")) for s in ("a", "b")])).alias("o")
    wanted = requests.select("request_id", "doc_id", "period", sides).select("request_id", "doc_id", "period", "o.side", "o.label", "o.scope")
    found = row_evidence(wanted, chunks)
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    error = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("side")))
    out = found.groupBy("request_id").agg(error.alias("error"), F.abs(at("a") - at("b")).alias("value"), F.array_sort(F.collect_set("page")).alias("pages"))
    return out.withColumn("error", F.when(F.col("error") == "VALUE_UNPARSED", "NON_NUMERIC").otherwise(F.col("error")))


def locate_rows(requests: DataFrame, words: DataFrame | None) -> DataFrame:
    """requests (request_id, doc_id, page, label, value) with a word table -> row_box, or NO_PDF without one, SAME_ROW_FAILED."""
    if words is None:
        return requests.select("request_id", F.lit("NO_PDF").alias("error"), F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>").alias("row_box"))
    of = [c for c in ("doc_id",) if c in requests.columns]
    find = lambda c: geometry.find_text(requests.select(F.col("request_id").alias("target_id"), *of, "page", F.col(c).alias("target")), words).withColumnRenamed("target_id", "pair_id")
    found = geometry.locate_rows(requests.select(F.col("request_id").alias("pair_id")), find("label"), find("value"))
    return found.select(F.col("pair_id").alias("request_id"), F.when(~F.col("same_row"), "SAME_ROW_FAILED").alias("error"), "row_box")
