"""Proof and refusal: spans in source text, guards on questions, completeness. Column expressions.

Refusal is data: a reason column in a fixed order of precedence, never an exception.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.amounts import parse_amounts, to_yuan
from ..functions.lexicon import CONSOLIDATED, LABEL_ALIAS
from ..functions.rewrite import expand_question
from ..functions.text import label_key, normalize_text, years_in


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def locate_span(claim: Column, text: Column) -> Column:
    """struct<mode, start, stop, span>: where the claim stands in the text (0-based), exact, else normalised; else null."""
    return F.when(~(_blank(claim) | text.isNull() | (text == "")), _span(claim, text, normalize_text(claim), normalize_text(text)))


def _span(claim: Column, text: Column, nc: Column, nt: Column) -> Column:
    """The same of a claim and a text that aren't blank and their normalised forms."""
    exact = F.call_function("instr", text, claim)
    loose = F.call_function("instr", nt, nc)
    hit = lambda mode, at, span: F.struct(F.lit(mode).alias("mode"), (at - 1).alias("start"), (at - 1 + F.length(span)).alias("stop"), span.alias("span"))
    return F.when(exact > 0, hit("exact", exact, claim)).when((nc != "") & (loose > 0), hit("normalized", loose, nc))


#: Characters of needles that one automaton holds; more are taken block by block.
BLOCK_CHARS = 1 << 20
_automata: dict[str, object] = {}


def _automaton(token: str, needles: list[tuple[str, list[int] | None]]):
    """The automaton of a block's needles, made once a worker (and one at a time)."""
    if token not in _automata:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, (needle, keys) in enumerate(needles):
            found.add_word(needle, (i, None if keys is None else frozenset(keys)))
        found.make_automaton()
        _automata.clear()
        _automata[token] = found
    return _automata[token]


def _dealt(asked: DataFrame, by: list[str], most: int) -> tuple[DataFrame, int]:
    """Distinct needles with a block of some `most` characters: by key, so that a text meets few blocks, and those of a hot key by needle."""
    size = F.length("needle").cast("bigint")
    total = asked.agg(F.sum(size).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // most))
    if blocks == 1:
        return asked.withColumn("block", F.lit(0)), 1
    if not by:
        return asked.withColumn("block", F.pmod(F.xxhash64("needle"), F.lit(blocks)).cast("int")), blocks
    # Keys with more than a block's characters: at most `blocks` of them.
    hot = asked.groupBy("key").agg(F.ceil(F.sum(size) / most).cast("bigint").alias("parts")).where("parts > 1")
    salt = F.pmod(F.xxhash64("needle"), F.coalesce("parts", F.lit(1)))
    return asked.join(F.broadcast(hot), "key", "left").withColumn("block", F.pmod(F.xxhash64("key", salt), F.lit(blocks)).cast("int")).drop("parts"), blocks


def containing(texts: DataFrame, plain: str, needles: DataFrame, needle: str, by: list[str] | None = None, most: int = BLOCK_CHARS) -> DataFrame:
    """Rows of texts joined with the needles that their `plain` contains, both normalised; needles can be many.

    by: columns of both tables that must agree too (a document's id), null never does; they come
    out once. Blocks of distinct needles (by their characters) become Aho-Corasick automata that
    are sent to every task; a block takes one pass over the texts (with `by`, over those of its
    keys), whatever the needles' lengths. Only hits leave it, so pairs grow with hits, not with
    texts times needles. A needle may hold any characters; empty and null ones are in nothing.
    """
    by = by or []
    key = F.xxhash64(*by) if by else F.lit(None).cast("bigint")
    given = needles.where(F.length(needle) > 0)
    body = texts.where(F.col(plain) != "")
    for c in by:
        given, body = given.where(F.col(c).isNotNull()), body.where(F.col(c).isNotNull())
    given = given.withColumn("needle_key", key)
    dealt, blocks = _dealt(given.select(F.col(needle).alias("needle"), F.col("needle_key").alias("key")).distinct(), by, most)
    if blocks > 1:
        dealt = dealt.persist()
    spark, out = texts.sparkSession, None
    schema = T.StructType([*body.schema.fields, T.StructField("needle_hit", T.StringType())])
    for k in range(blocks):
        # At most some `most` characters: what the automaton of the block holds.
        rows = dealt.where(F.col("block") == k).groupBy("needle").agg(F.collect_list("key").alias("keys")).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast([(r["needle"], r["keys"] if by else None) for r in rows])
        some = body.withColumn("needle_key", key)
        if by and blocks > 1:
            some = some.join(F.broadcast(dealt.where(F.col("block") == k).select(F.col("key").alias("needle_key")).distinct()), "needle_key", "left_semi").select(*body.columns, "needle_key")
        at = body.columns.index(plain)

        def search(batches, sent=sent, token=uuid.uuid4().hex, at=at):
            found = _automaton(token, sent.value)
            for b in batches:
                hit_rows, hits = [], []
                keys = b.column(b.num_columns - 1).to_pylist()
                for i, text in enumerate(b.column(at).to_pylist()):
                    met = {n for _, (n, of) in found.iter(text) if of is None or keys[i] in of}
                    hit_rows += [i] * len(met)
                    hits += sorted(met)
                taken = b.take(pa.array(hit_rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns[:-1], pa.array([sent.value[n][0] for n in hits], pa.string())], [*b.schema.names[:-1], "needle_hit"])

        met = some.mapInArrow(search, schema)
        out = met if out is None else out.union(met)
    columns = [c for c in needles.columns if c not in body.columns]
    if out is None:
        return spark.createDataFrame([], T.StructType([*body.schema.fields, *[needles.schema[c] for c in columns]]))
    given = given.drop("needle_key").withColumnRenamed(needle, "needle_hit")
    return out.join(given, ["needle_hit", *by]).withColumnRenamed("needle_hit", needle).select(*body.columns, *columns)


def locate_claims(claims: DataFrame, texts: DataFrame, most: int = BLOCK_CHARS) -> DataFrame:
    """claims (claim_id, claim) in all texts (text_id, text) -> claim_id, text_id, span: every pair with a hit.

    Both sides are normalised once a row, not once a pair; see containing().
    """
    body = texts.select("text_id", "text", normalize_text("text").alias("plain"))
    asked = claims.select("claim_id", "claim", normalize_text("claim").alias("needle"))
    pairs = containing(body, "plain", asked, "needle", most=most)
    return pairs.select("claim_id", "text_id", _span(F.col("claim"), F.col("text"), F.col("needle"), F.col("plain")).alias("span"))


def value_in_span(span: Column, value: Column, unit: Column, rel_tolerance: float | str = 0) -> Column:
    """Whether any amount of the span equals the value in yuan, or lies within a relative tolerance (a decimal)."""
    expected = to_yuan(value, unit)
    tolerance = F.lit(str(rel_tolerance)).cast("decimal(10,6)")

    def fits(a: Column) -> Column:
        gap = F.abs(a["normalized"] - expected).cast("decimal(28,8)")
        near = (tolerance > 0) & (expected != 0) & (gap <= (F.abs(expected).cast("decimal(22,8)") * tolerance).cast("decimal(28,8)"))
        return (a["normalized"] == expected) | near

    return F.coalesce(F.exists(parse_amounts(span), fits), F.lit(False))


def verify_evidence(claim: Column, text: Column, value: Column, unit: Column, rel_tolerance: float | str = 0) -> Column:
    """struct<accepted, reason, mode, start, stop>; reasons: EMPTY_SPAN, SPAN_NOT_FOUND, VALUE_NOT_IN_SPAN."""
    hit = locate_span(claim, text)
    reason = F.when(_blank(claim), "EMPTY_SPAN").when(hit.isNull(), "SPAN_NOT_FOUND").when(~value_in_span(hit["span"], value, unit, rel_tolerance), "VALUE_NOT_IN_SPAN")
    return F.struct(reason.isNull().alias("accepted"), reason.alias("reason"), hit["mode"].alias("mode"), hit["start"].alias("start"), hit["stop"].alias("stop"))


SIX_TUPLE = ("company", "period", "metric", "value", "unit", "source")


def missing_fields(**fields: Column) -> Column:
    """Names of fields that are null or blank, in the given order. Zero isn't missing."""
    return F.filter(F.array(*[F.when(_blank(c.cast("string")), F.lit(n)) for n, c in fields.items()]), lambda x: x.isNotNull())


def owns(name: Column, company: Column, aliases: Column) -> Column:
    """Whether a name means the document's own issuer."""
    own = F.call_function("contains", company, name) | F.exists(aliases, lambda a: (a != "") & F.call_function("contains", name, a))
    return F.coalesce((name != "") & own, F.lit(False))


def constraint_error(question: Column, company: Column, aliases: Column, issuers: Column, years: Column) -> Column:
    """OUT_OF_DOCUMENT_PERIOD, then WRONG_DOCUMENT, else null."""
    asked = years_in(question)
    outside = (F.size(years) > 0) & (F.size(F.array_except(asked, years)) > 0)
    foreign = F.exists(issuers, lambda n: (n != "") & F.call_function("contains", question, n) & ~owns(n, company, aliases))
    return F.when(F.coalesce(outside, F.lit(False)), "OUT_OF_DOCUMENT_PERIOD").when(F.coalesce(foreign, F.lit(False)), "WRONG_DOCUMENT")


def label_error(question: Column, chosen: Column, labels: Column, keys: Column | None = None) -> Column:
    """Why the chosen item isn't the one asked for (no_label, none_named, other_item, part_of_item), else null.

    keys: the labels' label_key() where they are at hand, so they aren't made for each question.
    """
    q, c = label_key(expand_question(question)), label_key(chosen)
    named = F.filter(F.transform(labels, label_key) if keys is None else keys, lambda k: (F.length(k) >= 2) & F.call_function("contains", q, k))
    return (
        F.when(_blank(chosen), "no_label").when(F.size(named) == 0, "none_named").when(~F.array_contains(named, c), "other_item")
        .when(F.exists(named, lambda k: (k != c) & F.call_function("contains", k, c)), "part_of_item")
    )


def printed_label(label: Column, known: Column) -> Column:
    """The name a statement prints: the label itself, else its alias; exact only, null if neither is known."""
    alias = F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_ALIAS.items() for x in kv]), label)
    return F.when(F.array_contains(known, label), label).when(F.array_contains(known, alias), alias)


def by_label_scope(chunks: DataFrame) -> DataFrame:
    """The first chunk of each (doc_id, label, scope) in document order."""
    order = Window.partitionBy("doc_id", "label", "scope").orderBy("table_index", "row_index")
    return chunks.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def by_label(chunks: DataFrame) -> DataFrame:
    """The primary chunk of each (doc_id, label): consolidated, then without scope, then parent; the first in order."""
    preference = F.when(F.col("scope") == CONSOLIDATED, 0).when(F.col("scope").isNull(), 1).otherwise(2)
    order = Window.partitionBy("doc_id", "label").orderBy(preference, "table_index", "row_index")
    return chunks.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def resolve_rows(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """wanted (key columns, doc_id, label, scope) with the row it means: row struct, error.

    Errors: AMBIGUOUS_SCOPE (no scope asked, several exist; decided after the alias),
    SCOPE_NOT_AVAILABLE, LABEL_NOT_FOUND. An item without scope in the index is also found
    when a scope is asked only if it carries that scope.
    """
    alias = F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_ALIAS.items() for x in kv]), F.col("label"))
    keys = [c for c in wanted.columns]
    options = wanted.withColumn("option", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("ord"), F.col("label").alias("name")), F.struct(F.lit(1).alias("ord"), alias.alias("name"))), lambda o: o["name"].isNotNull())))
    # Only chunks of the names asked for are ranked and collected.
    named = options.select("doc_id", F.col("option.name").alias("label")).distinct()
    scoped = by_label_scope(chunks.join(named, ["doc_id", "label"], "left_semi"))
    per = scoped.groupBy("doc_id", "label").agg(F.array_sort(F.collect_set("scope")).alias("scopes"), F.collect_list(F.struct("scope", "chunk_id", "page", "values", "text", "section")).alias("found"))
    per = per.select(F.col("doc_id").alias("of_doc"), F.col("label").alias("printed"), "scopes", "found")
    joined = options.join(per, (F.col("doc_id") == F.col("of_doc")) & (F.col("option.name") == F.col("printed")), "left")
    best = joined.groupBy(*keys).agg(F.min_by(F.struct("printed", "scopes", "found"), F.when(F.col("printed").isNotNull(), F.col("option.ord"))).alias("b"))
    hit = F.filter("b.found", lambda r: F.when(F.col("scope").isNull(), F.lit(True)).otherwise(r["scope"] == F.col("scope")))
    error = (
        F.when(F.col("b.printed").isNull(), "LABEL_NOT_FOUND").when(F.col("scope").isNull() & (F.size("b.scopes") > 1), "AMBIGUOUS_SCOPE")
        .when(F.size(hit) == 0, "SCOPE_NOT_AVAILABLE")
    )
    preferred = F.array_min(F.transform(hit, lambda r: F.struct(F.when(r["scope"] == CONSOLIDATED, 0).when(r["scope"].isNull(), 1).otherwise(2).alias("o"), r.alias("r"))))["r"]
    return best.select(*keys, F.col("b.printed").alias("printed"), error.alias("error"), F.when(error.isNull(), preferred).alias("row"))
