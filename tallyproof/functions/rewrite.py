"""What a question says: short names, scope, years, intent, operands. Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ALIASES, AMBIGUOUS, CONSOLIDATED, FORMULA_HINTS, PARENT, VERIFY_WORDS
from .text import _col, label_key

#: After a short name these mean that it is the start of a longer name.
_NOT_BEFORE = r"(?![入出]小计|量表)"
_CANONICAL = {*ALIASES.values(), *(x for v in AMBIGUOUS.values() for x in v)}


def _pattern() -> str:
    keys = sorted({*ALIASES, *AMBIGUOUS, *_CANONICAL}, key=lambda k: (-len(k), k))
    return f"((?:{'|'.join(map(re.escape, keys))}){_NOT_BEFORE}|(?s:.))"


def _pieces(q: Column) -> Column:
    """The question as a list of known names and single characters: one pass from the left, longest name first."""
    return F.regexp_extract_all(F.coalesce(q, F.lit("")), F.lit(_pattern()), F.lit(1))


def expand_question(c: Column | str) -> Column:
    """Short names with one meaning in full. A replacement is never looked at again, so it can't be taken for a short name."""
    full = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.array_join(F.transform(_pieces(_col(c)), lambda p: F.coalesce(F.try_element_at(full, p), p)), "")


def ambiguous_names(c: Column | str) -> Column:
    """array<struct<key, options>>: ambiguous short names in order of first appearance."""
    options = F.create_map(*[x for k, v in AMBIGUOUS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.array_distinct(F.filter(_pieces(_col(c)), lambda p: p.isin(*AMBIGUOUS)))
    return F.transform(found, lambda k: F.struct(k.alias("key"), F.try_element_at(options, k).alias("options")))


def longest_ambiguous(c: Column | str) -> Column:
    """struct<key, options> of the longest ambiguous name (ties: the greater string), else null."""
    ranked = F.transform(ambiguous_names(c), lambda a: F.struct(F.length(a["key"]).alias("n"), a["key"].alias("key"), a["options"].alias("options")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct(best["key"].alias("key"), best["options"].alias("options")))


def _names_parent(q: Column) -> Column:
    return q.rlike(f"(?<!归属于){PARENT}|本部|母公司报表|母公司口径")


def question_scope(c: Column | str) -> Column:
    """The scope that a question names; null if none or both."""
    q = F.coalesce(_col(c), F.lit(""))
    parent, whole = _names_parent(q), q.contains(CONSOLIDATED)
    return F.when(parent & ~whole, PARENT).when(whole & ~parent, CONSOLIDATED)


def both_scopes(c: Column | str) -> Column:
    q = F.coalesce(_col(c), F.lit(""))
    return _names_parent(q) & q.contains(CONSOLIDATED)


def caption_scope(c: Column | str) -> Column:
    """The scope that a table's caption tells; null means that none is stated, never a default."""
    return F.when(_col(c).rlike("母公司|本部"), PARENT).when(_col(c).contains(CONSOLIDATED), CONSOLIDATED)


def formula_hits(c: Column | str) -> Column:
    """array<struct<hits, ord, formula_id, distinctive>> of the formulas whose hint words occur often enough."""
    q = F.coalesce(_col(c), F.lit(""))
    rows = []
    for i, (fid, (words, least)) in enumerate(FORMULA_HINTS.items()):
        hits = sum((q.contains(w).cast("int") for w in words), F.lit(0))
        rows.append(F.struct(hits.alias("hits"), F.lit(-i).alias("ord"), F.lit(fid).alias("formula_id"), F.lit(least == 1).alias("distinctive"), (hits >= least).alias("met")))
    return F.filter(F.array(*rows), lambda r: r["met"])


def wants_check(c: Column | str) -> Column:
    q = F.coalesce(_col(c), F.lit(""))
    return q.rlike("|".join((*VERIFY_WORDS, "=", r"\+", "＋"))) | F.exists(formula_hits(q), lambda r: r["distinctive"])


def check_formula(c: Column | str) -> Column:
    """The formula to check: most hint words, ties by registry order; F1 if none is met."""
    return F.coalesce(F.array_max(formula_hits(c))["formula_id"], F.lit("F1"))


def best_label(question: Column, labels: Column) -> Column:
    """The longest known label (array<string>) that a question contains, short names expanded; ties: the first."""
    q = label_key(expand_question(question))
    ranked = F.transform(labels, lambda x, i: F.struct(F.length(label_key(x)).alias("n"), (-i).alias("i"), x.alias("label")))
    named = F.filter(ranked, lambda r: (r["n"] >= 2) & F.call_function("contains", q, label_key(r["label"])))
    return F.array_max(named)["label"]


def difference_operands(question: Column, labels: Column) -> Column:
    """array<struct<label, scope>>: what "the difference of X and Y" names, each once."""
    whole = question_scope(question)
    parts = F.filter(F.transform(F.split(F.coalesce(question, F.lit("")), "以及|与|及|和|、|,|，"), lambda x: F.trim(x)), lambda s: s != "")
    own = lambda s: F.when(s.rlike("口径|报表|本部"), question_scope(s)).otherwise(whole)
    each = F.transform(parts, lambda s: F.struct(best_label(s, labels).alias("label"), own(s).alias("scope")))
    return F.array_distinct(F.filter(each, lambda o: o["label"].isNotNull()))


def route(question: Column, operands: Column) -> Column:
    """VERIFY, DIFF (with exactly two operands) or LOOKUP."""
    q = F.coalesce(question, F.lit(""))
    return F.when(wants_check(q), "VERIFY").when(q.rlike("相差|差额|之差") & (F.size(operands) == 2), "DIFF").otherwise("LOOKUP")
