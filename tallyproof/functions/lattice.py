"""Segmentation of unspaced text: the most probable path through a lattice of words.

A text's lattice has an edge for each known word that stands somewhere in it, and for each
single character. A path's probability is the product of its words' shares of all counts; the
most probable path is found by dynamic programming from the end. Costs are whole numbers
(10**-6 nats), so sums are exact; on equal costs the longer first word wins.

Words come from the vocabulary (with a high fixed count) and from the corpus: Han n-grams
that are frequent and free, that is, have different neighbours on both sides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import FINANCIAL_TERMS, STOP_WORDS
from .text import CJK

#: Fixed value: the count of a word of the vocabulary.
TERM_COUNT = 100_000
#: Words of a lattice at most: they are sent to every task.
MOST_WORDS = 1 << 20
UNIT = 1_000_000

_HAN = "[一-鿿]+"
_RUN = re.compile(f"{_HAN}|[A-Za-z0-9]+")


class Lattice:
    """Known words with their costs; a single character that isn't known counts once."""

    def __init__(self, counts: dict[str, int]):
        total = max(sum(counts.values()), 1)
        self.costs = {w: round(UNIT * (math.log(total) - math.log(n))) for w, n in counts.items() if w and n > 0}
        self.unknown = round(UNIT * math.log(total))
        self.longest = max(map(len, self.costs), default=1)

    def path(self, text: str) -> list[str]:
        """The words of the most probable path."""
        n = len(text)
        best, step = [0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            best[i] = self.costs.get(text[i], self.unknown) + best[i + 1]
            for size in range(2, min(self.longest, n - i) + 1):
                cost = self.costs.get(text[i : i + size])
                if cost is not None and cost + best[i + size] <= best[i]:
                    best[i], step[i] = cost + best[i + size], size
        out, i = [], 0
        while i < n:
            out.append(text[i : i + step[i]])
            i += step[i]
        return out

    def tokens(self, text: str) -> Iterator[str]:
        """Words of Han runs, runs of letters and digits as they are; no stop words."""
        for run in _RUN.findall(text):
            for word in self.path(run) if run[0] >= "一" else (run,):
                if word not in STOP_WORDS:
                    yield word


def corpus_words(texts: DataFrame, text: str, longest: int = 4, least: int = 5) -> DataFrame:
    """(word, n): Han n-grams of 2 to `longest` characters that occur `least` times and have two neighbours at least on each side.

    The border of a run counts as two neighbours, as a word may end there.
    """
    run = F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"([{CJK}]+)"), F.lit(1)))
    runs = texts.select(run.alias("r"))
    sizes = F.explode(F.sequence(F.lit(2), F.least(F.length("r"), F.lit(longest)))).alias("n")
    places = F.explode(F.sequence(F.lit(1), F.length("r") - F.col("n") + 1)).alias("i")
    at = runs.where(F.length("r") >= 2).select("r", sizes).select("r", "n", places)
    around = lambda start, border: F.when(border, F.lit("")).otherwise(F.substring(F.col("r"), start, F.lit(1)))
    end = F.col("i") + F.col("n")
    grams = at.select(F.substring(F.col("r"), F.col("i"), F.col("n")).alias("word"), around(F.col("i") - 1, F.col("i") == 1).alias("before"), around(end, end > F.length("r")).alias("after"))
    # Rows are counted by gram and neighbours first, so a frequent gram is no large group.
    counts = grams.groupBy("word", "before", "after").agg(F.count("*").alias("n"))
    free = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c))) + F.when(F.bool_or(F.col(c) == ""), 2).otherwise(0)
    found = counts.groupBy("word").agg(F.sum("n").alias("n"), free("before").alias("b"), free("after").alias("a"))
    return found.where((F.col("n") >= least) & (F.col("a") >= 2) & (F.col("b") >= 2)).select("word", "n")


def with_vocabulary(words: DataFrame, terms: Iterable[str] = FINANCIAL_TERMS) -> DataFrame:
    """words (word, n) and the vocabulary's, which have TERM_COUNT; stop words of several characters are words too."""
    fixed = sorted({*terms, *(w for w in STOP_WORDS if len(w) > 1)})
    known = words.sparkSession.createDataFrame([(w, TERM_COUNT) for w in fixed], "word string, n bigint")
    return words.join(F.broadcast(known), "word", "left_anti").unionByName(known)


def lattice_of(words: DataFrame) -> Lattice:
    """The lattice of a table (word, n) of at most MOST_WORDS rows; more are an error."""
    rows = words.where("n > 0 AND word <> ''").groupBy("word").agg(F.sum("n").alias("n")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words; raise `least`")
    return Lattice({r["word"]: r["n"] for r in rows})


def _mapped(c: Column | str, words: Callable[[str], Iterable[str]]) -> Column:
    def run(column: pa.Array) -> pa.Array:
        known: dict[str | None, list[str]] = {None: []}
        for t in column.to_pylist():
            if t not in known:
                known[t] = list(words(t))
        return pa.array([known[t] for t in column.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(F.col(c) if isinstance(c, str) else c)


def segment(c: Column | str, lattice: Lattice) -> Column:
    """The whole text, of any characters, cut into words; null: none."""
    return _mapped(c, lattice.path)


def tokenize_by(c: Column | str, lattice: Lattice) -> Column:
    """Tokens for retrieval: words by lattice, runs of letters and digits, no stop words; null: none."""
    return _mapped(c, lattice.tokens)
