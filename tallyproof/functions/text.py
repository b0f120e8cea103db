"""Text functions as Column expressions (JVM only, apart from the optional exact NFKC)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import FINANCIAL_TERMS, STOP_WORDS

CJK = r"\x{4e00}-\x{9fff}"
_DASHES = "‐‑‒–—−－"
_QUOTES = "‘’“”「」『』"
_SPACES = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())


@lru_cache
def _single_forms() -> tuple[str, str]:
    """Code points of the basic plane whose compatibility form is one other code point, and these forms."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache
def _multiple_forms() -> dict[str, str]:
    """Code points of the basic plane whose compatibility form is several code points, and these forms."""
    pairs = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000}
    return {a: b for a, b in pairs.items() if len(b) > 1}


#: Stands for a code point whose form is several code points, while looking for one; no character.
_MARK = "\ufffe"


def _fold(c: Column, source: str, target: str) -> Column:
    """translate(), and forms of several code points spelt out; texts without any (nearly all) take one pass."""
    forms = _multiple_forms()
    table = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in forms.items())), F.lit("\x01"), F.lit("\x02"))
    known = F.array(F.translate(c, "".join(forms) + source, _MARK * len(forms) + target))
    spelt = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.translate(x, "".join(forms), "") == "", F.try_element_at(table, x)).otherwise(x)), "")
    return F.transform(known, lambda t: F.when(t.contains(_MARK), F.translate(spelt, source, target)).otherwise(t))[0]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_width(c: Column | str) -> Column:
    """NFKC for all forms of one code point (full and half width, compatibility letters), by one table; for numbers and names."""
    return F.translate(_col(c), *_single_forms())


def nfkc(c: Column | str) -> Column:
    """Exact NFKC, which also composes letters and the marks behind them; an Arrow function, so off the default path."""
    exact = F.pandas_udf(lambda s: s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x)), "string")
    return exact(_col(c))


def normalize_text(c: Column | str, exact: bool = False, cell: bool = False) -> Column:
    """NFKC of each code point (ligatures, fractions and squared words too), all white space removed, dashes and quotes in their ASCII forms; null: ''.

    cell: a table's cell, of which only digits, signs and fixed headers matter; forms of one code point do.
    """
    text = F.coalesce(_col(c), F.lit(""))
    text = nfkc(text) if exact else text
    source, target = _single_forms()
    table = {a: b for a, b in zip(source, target)}
    table |= {d: "-" for d in _DASHES} | dict(zip(_QUOTES, "''\"\"" + '""""'))
    removed = {s for s in _SPACES} | {a for a, b in table.items() if b in _SPACES}
    table = {a: b for a, b in table.items() if a not in removed}
    tables = "".join(table) + "".join(sorted(removed)), "".join(table.values())
    return F.translate(text, *tables) if cell or exact else _fold(text, *tables)


def squash(c: Column | str) -> Column:
    """Compatibility forms folded and white space removed, nothing else."""
    return F.regexp_replace(fold_width(F.coalesce(_col(c), F.lit(""))), r"(?U)\s+", "")


# Footnotes, ordinals and qualifiers around item names.
_FOOTNOTE = r"[（(](?:净亏损|净收益|亏损|收益)[^）)]*号填列[）)]\s*$"
_ORDINAL = r"[(（]?[一二三四五六七八九十0-9]{1,3}[)）、.．]\s*"
_QUALIFIER = r"(?:其中|加|减|＋)[:：]{0,2}\s*"


def clean_label(c: Column | str) -> Column:
    """Item names without a filling-in footnote, and without ordinals and qualifiers in front."""
    text = F.trim(F.coalesce(_col(c), F.lit("")))
    text = F.trim(F.regexp_replace(text, _FOOTNOTE, ""))
    return F.trim(F.regexp_replace(text, rf"^(?:\s*(?:{_ORDINAL}|{_QUALIFIER}))+", ""))


def label_key(c: Column | str) -> Column:
    """Names and questions in comparable form: no brackets' content, only Han characters, letters and digits."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[（(][^）)]*[）)]", "")
    return F.regexp_replace(text, rf"[^{CJK}A-Za-z0-9]+", "")


def _token_pattern(terms: tuple[str, ...]) -> str:
    words = sorted({*terms, *(w for w in STOP_WORDS if len(w) > 1)}, key=lambda w: (-len(w), w))
    return "|".join(map(re.escape, words)) + rf"|[A-Za-z0-9]+|[{CJK}]"


def tokenize(c: Column | str, terms: tuple[str, ...] = FINANCIAL_TERMS) -> Column:
    """Words by longest match over the vocabulary, else runs of letters and digits, else single characters; no stop words."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(f"({_token_pattern(terms)})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def is_number_token(t: Column) -> Column:
    return t.rlike(r"^[0-9,，.]+$")


def looks_like_amount(c: Column | str) -> Column:
    """An amount cell: digits with a grouping comma, two decimals, or five characters at least."""
    t = F.regexp_replace(normalize_text(c, cell=True), "，", ",")
    body = F.length(F.regexp_replace(t, "^-+", ""))
    return t.rlike(r"^-?[0-9,]+(?:\.[0-9]+)?$") & (t.contains(",") | t.rlike(r"\.[0-9]{2}$") | (body >= 5))


def looks_like_date(c: Column | str) -> Column:
    return normalize_text(c, cell=True).rlike(r"[0-9]{4}[年\-/][0-9]{1,2}[月\-/][0-9]{1,2}")


def years_in(c: Column | str, bounded: bool = True) -> Column:
    """Distinct years 19xx and 20xx, ascending; bounded: not inside a longer number."""
    pattern = r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])" if bounded else r"((?:19|20)[0-9]{2})"
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(pattern), F.lit(1)), lambda y: y.cast("int"))))


def fragment(text: Column | str, value: Column | str, lead: int = 40) -> Column:
    """The stretch of `text` that ends with `value` and starts after the last but one bar of the 40 characters before it."""
    text, value = _col(text), _col(value)
    at = F.call_function("instr", text, value)
    window = F.substring(text, F.greatest(at - lead, F.lit(1)), F.least(at - 1, F.lit(lead)))
    parts = F.split(window, r"\|")
    tail = F.when(F.size(parts) >= 3, F.concat_ws("|", F.slice(parts, -2, 2))).otherwise(window)
    found = F.trim(F.regexp_replace(F.trim(F.concat(tail, value)), r"^\|+", ""))
    return F.when(at == 0, value).otherwise(found)


def page_span(first: Column | str, last: Column | str) -> Column:
    first, last = _col(first), _col(last)
    return F.when(first == last, F.concat(F.lit("p"), first.cast("string"))).otherwise(F.concat(F.lit("p"), first.cast("string"), F.lit("-p"), last.cast("string")))


def chunk_text(label: Column, section: Column, values: Column) -> Column:
    """`label | section | values…` without empty parts."""
    return F.concat_ws(" | ", F.filter(F.concat(F.array(label, F.coalesce(section, F.lit(""))), values), lambda p: p != ""))


# Legal forms.
_SUFFIX = r"(?:股份有限公司|有限责任公司|有限公司|集团|公司)$"


def company_aliases(name: Column | str) -> Column:
    """Names that mean the issuer: in full, without its legal form, and the first four characters of six or more."""
    name = F.coalesce(_col(name), F.lit(""))
    short = F.regexp_replace(name, _SUFFIX, "")
    options = F.array(name, short, F.when(F.length(name) >= 6, F.substring(name, 1, 4)))
    return F.array_distinct(F.filter(options, lambda x: x.isNotNull() & (F.length(x) >= 2)))


MAX_QUESTION = 200


def question_error(c: Column | str) -> Column:
    """Why a question can't be taken at all ('empty', 'too long'), else null. An input error, not a refusal."""
    q = F.trim(_col(c))
    return F.when(q.isNull() | (q == ""), "empty").when(F.length(q) > MAX_QUESTION, "too long")


def strip_tags(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), "<[^>]+>", ""), "&nbsp;|\\x{00a0}", " "))
