"""Exact decimal amounts. Values are decimal(28,8), in yuan decimal(38,8); never doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, fold_width

# Units in text, and their factor to yuan.
UNITS = {"元": 1, "千元": 10**3, "万元": 10**4, "百万元": 10**6, "亿元": 10**8, "千": 10**3, "万": 10**4, "亿": 10**8}
# Units that a report may declare.
DISCLOSURE_UNITS = {"元": 1, "千元": 10**3, "万元": 10**4, "百万元": 10**6, "亿元": 10**8}

VALUE, YUAN = "decimal(28,8)", "decimal(38,8)"
NUMBER = r"[+-]?(?:[0-9]{1,3}(?:[,，][0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
_PAREN = rf"[（(]({NUMBER})[)）]"
_PLAIN = rf"({NUMBER}(?:\s*(?:{_UNIT}))?)"


def _factor(unit: Column, table: dict[str, int]) -> Column:
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, F.coalesce(unit, F.lit(""))), F.lit(1)).cast("decimal(9,0)")


def to_decimal(c: Column | str, kind: str = VALUE) -> Column:
    """A number with grouping commas, else null. Only plain digits: no exponents, NaN or infinity."""
    text = F.trim(F.regexp_replace(_col(c), "[,，]", ""))
    return F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), text).try_cast(kind)


def to_yuan(value: Column, unit: Column) -> Column:
    """value in yuan; an unknown or missing unit counts as yuan."""
    return (value.cast(VALUE) * _factor(unit, UNITS)).cast(YUAN)


def unit_scale(unit: Column | str) -> Column:
    return _factor(F.trim(_col(unit)), DISCLOSURE_UNITS)


def is_known_unit(unit: Column | str) -> Column:
    return F.coalesce(F.trim(_col(unit)).isin(*DISCLOSURE_UNITS), F.lit(False))


def _read(raw: Column, value: Column, unit: Column) -> Column:
    return F.struct(raw.alias("raw"), value.alias("value"), unit.alias("unit"))


def _amount(a: Column) -> Column:
    value, unit = a["value"], a["unit"]
    return F.struct(a["raw"].alias("raw"), value.alias("value"), unit.alias("unit"), to_yuan(value, unit).alias("normalized"), unit.isNull().alias("unit_assumed"))


def parse_amounts(c: Column | str) -> Column:
    """All amounts of a text, array<struct<raw, value, unit, normalized, unit_assumed>>.

    Bracketed negatives come first and are taken out of the text; then all others in order,
    repeated ones too. Years and parts of dates count as amounts.
    """
    text = fold_width(F.coalesce(_col(c), F.lit("")))
    negative = F.transform(F.regexp_extract_all(text, F.lit(f"({_PAREN})"), F.lit(1)), lambda m: _read(m, -to_decimal(F.substring(m, F.lit(2), F.length(m) - 2)), F.lit(None).cast("string")))
    rest = F.regexp_replace(text, _PAREN, " ")

    def plain(m: Column) -> Column:
        unit = F.regexp_extract(m, f"({_UNIT})$", 1)
        return _read(F.trim(m), to_decimal(F.regexp_extract(m, f"^{NUMBER}", 0)), F.when(unit != "", unit))

    positive = F.transform(F.regexp_extract_all(rest, F.lit(_PLAIN), F.lit(1)), plain)
    # Numbers and units are read once each, then filtered, then scaled.
    return F.transform(F.filter(F.concat(negative, positive), lambda a: a["value"].isNotNull()), _amount)


def single_amount(c: Column | str) -> Column:
    """The amount of a text that has exactly one, else null."""
    once = F.transform(F.array(parse_amounts(c)), lambda found: F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))))
    return F.try_element_at(once, F.lit(1))


def quantize(c: Column) -> Column:
    """Two decimals, half up."""
    return F.round(c, 2)


def _narrow(c: Column) -> Column:
    return c.cast("decimal(20,4)")


def safe_div(a: Column, b: Column) -> Column:
    """decimal(38,18) quotient; null on zero."""
    return F.try_divide(_narrow(a), _narrow(b))


def pct_change(current: Column, prior: Column) -> Column:
    """Change in percent, two decimals; null unless the base is positive."""
    return F.when(prior > 0, quantize(safe_div(_narrow(current) - _narrow(prior), prior) * 100))


def signed_pct_change(current: Column, prior: Column) -> Column:
    """Change in percent of the base's magnitude; null on a zero base."""
    return quantize(safe_div(_narrow(current) - _narrow(prior), F.abs(prior)) * 100)
