"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words (a fixed list for each of four languages, and
words and word beginnings learned from labelled text), lexicon words near second-person
words, capitals, punctuation and obfuscation rates, and plain size measures. All are computed
from the bytes of a whole text with numpy. Words are runs of letters, digits, '@' and
apostrophes between letters; case counts for none of A-Z and the letters from À to Þ.

The learned lexicon holds words, and beginnings of 4 and 5 bytes, whose documents are
toxic more often than chance by a log-likelihood ratio G2 >= LEAST_G2; such a word is in
several toxic documents of the sample, so the sample's size bounds it. Each training row's features use a lexicon from the other
half of the sample, so a row's own label never reaches its features. Scores are calibrated
on out-of-fold predictions.

Fitted on at most SAMPLE labelled rows (bounded by parameter; the first by a hash of the
id; of rows that share an id, one text, toxic if any label of the id says so); applied to every row. Without labels of both values all scores are the share of
toxic labels (0 without any). Null and empty texts have a feature vector of zeros and are
scored like any other; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample, split_of, with_text
from .trees import BoostedTrees, Isotonic
from .words import LOWER, byte_hashes, lanes, mix64, text_blocks, token_spans

SAMPLE = 12_000
LEAST_G2 = 20.0
THRESHOLD = 0.7
FOLDS = 2

# Insults and hostile words of four languages. Words that are common and harmless
# in another of them (like German "die") are left out.
INSULTS = {
    "en": "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns fool fools imbecile cretin coward liar filth filthy vermin pig pigs ugly hate hateful despicable vile useless ignorant jerk creep bastard damn crap",
    "de": "idioten dumm dummkopf trottel abschaum arschloch wertlos ekelhaft verlierer müll",
    "fr": "imbécile crétin débile ordure salaud connard minable dégoûtant",
    "es": "imbécil estúpido tonto basura escoria perdedor asqueroso inútil",
}
# Second-person words, again without those that mean something else in another language.
SECOND_PERSON = {"en": "you your yours yourself you're", "de": "dich dir dein deine deiner euch euer", "fr": "toi vous votre vos", "es": "tú usted ustedes vosotros vosotras"}

_U = np.uint64


def _mask(f) -> np.ndarray:
    return np.array([f(b) for b in range(256)])


_LETTER = _mask(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80)
_DIGIT = _mask(lambda b: 48 <= b <= 57)
_UPPER = _mask(lambda b: 65 <= b <= 90)
_PUNCT = _mask(lambda b: 33 <= b <= 126 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_SPACE = _mask(lambda b: b == 32 or 9 <= b <= 13)
_ODD = _mask(lambda b: chr(b) in "*#$%&@|~^_+=<>\\")
_TOKEN = _LETTER | _DIGIT | _mask(lambda b: chr(b) in "@'")
#: Digits and signs that stand for letters, on top of lower case.
_STANDS = LOWER.copy()
_STANDS[[ord(c) for c in "013457@"]] = [ord(c) for c in "oieasta"]


def plain(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case (A-Z, and the letters from À to Þ in UTF-8), with letters for digits and signs that stand for them."""
    out = _STANDS[data]
    accented = np.flatnonzero(data[:-1] == 0xC3) + 1
    accented = accented[(data[accented] >= 0x80) & (data[accented] <= 0x9E) & (data[accented] != 0x97)]
    out[accented] += 0x20
    return out


def _known(words: str) -> np.ndarray:
    out = []
    for w in words.split():
        d = plain(np.frombuffer(w.encode(), np.uint8))
        out.append(byte_hashes(d, np.array([0]), np.array([len(d)]), 2)[0])
    return np.unique(np.array(out, _U))


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(x):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _words(data: np.ndarray, offsets: np.ndarray):
    """Words of a block: starts, ends, bounds by document, and keys (whole word, first 4 and first 5 bytes)."""
    quotes = np.flatnonzero(data == 39)
    inside = (quotes > 0) & (quotes < len(data) - 1)
    inside[inside] = _LETTER[data[quotes[inside] - 1]] & _LETTER[data[quotes[inside] + 1]]
    text = plain(data)
    text[quotes[~inside]] = 32
    start, end = token_spans(text, offsets, _TOKEN)
    view = lanes(text)
    keys = [byte_hashes(text, start, end, 2, view)]
    for k in (4, 5):
        keys.append(np.where(end - start >= k, mix64(byte_hashes(text, start, np.minimum(end, start + k), 2, view), 40 + k), _U(0)))
    return start, end, np.searchsorted(start, offsets), keys


FEATURES = 30


def features(column: pa.Array, lexicon: list[np.ndarray]) -> np.ndarray:
    """(rows, FEATURES) of whole texts; lexicon: sorted hashes of learned words and beginnings."""
    fixed, second = [_known(w) for w in INSULTS.values()], _known(" ".join(SECOND_PERSON.values()))
    parts = [np.zeros((0, FEATURES))]
    for a, e, data, offs in text_blocks(column):
        n = e - a
        size = np.diff(offs)
        start, end, bounds, keys = _words(data, offs)
        of = np.repeat(np.arange(n), np.diff(bounds))
        per = lambda hit: np.bincount(of, hit, n)
        words = np.maximum(np.diff(bounds), 1)
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
        upper, punct, digit, letter = _UPPER[data], _PUNCT[data], _DIGIT[data], _LETTER[data]
        total = np.maximum(size, 1)
        by_language = [_isin(keys[0], f) for f in fixed]
        is_fixed, is_you = np.logical_or.reduce(by_language), _isin(keys[0], second)
        learned = [_isin(k, t) for k, t in zip(keys, lexicon)]
        any_hit = is_fixed | learned[0] | learned[1] | learned[2]
        near = np.zeros(len(of), bool)
        for d in range(1, 6):
            near[d:] |= is_you[:-d] & (of[d:] == of[:-d])
            near[:-d] |= is_you[d:] & (of[:-d] == of[d:])
        cum = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        c_upper, c_digit, c_letter = cum(upper), cum(digit), cum(letter)
        w_len = end - start
        w_upper, w_digit, w_letter = (c[end] - c[start] for c in (c_upper, c_digit, c_letter))
        double = np.zeros(len(data), bool)
        double[1:] = punct[1:] & (data[1:] == data[:-1])
        inner = np.zeros(len(data), bool)
        inner[1:-1] = _ODD[data][1:-1] & letter[:-2] & letter[2:]
        hits = per(any_hit)
        x = np.stack(
            [
                *(per(f) / words for f in by_language),
                per(is_fixed) / words, per(learned[0]) / words, per(learned[1]) / words, per(learned[2]) / words,
                np.log1p(per(is_fixed)), np.log1p(per(learned[0])), np.log1p(per(learned[1])), np.log1p(per(learned[2])),
                hits / words, np.log1p(hits), (hits > 0).astype(float), (hits > 1).astype(float),
                per(any_hit & (w_upper >= 1)) / words, per(any_hit & near) / words, per(is_you) / words,
                count(upper) / total, per((w_upper == w_len) & (w_len > 1)) / words,
                count(punct) / total, count(double) / total, count(data == 33) / total, count(data == 63) / total,
                per((w_digit > 0) & (w_letter > 0)) / words, count(inner) / words, count(digit) / total,
                np.log1p(np.diff(bounds)), size / words,
            ],
            1,
        )
        x[size == 0] = 0
        parts.append(x)
    return np.concatenate(parts)


def _learn_lexicon(rows: DataFrame, least: float) -> list[list[np.ndarray]]:
    """Lexicons from all training rows, and from the rows outside each fold. rows: (text, y, fold)."""

    def run(batches):
        for b in batches:
            y, fold = b.column(1).to_numpy(), b.column(2).to_numpy()
            keys, cells = [], []
            for a, e, data, offs in text_blocks(b.column(0)):
                _, _, bounds, ks = _words(data, offs)
                for i in range(e - a):
                    for kind, k in enumerate(ks):
                        u = np.unique(k[bounds[i] : bounds[i + 1]])
                        u = u[u != 0]
                        keys.append(u)
                        cells.append(np.full(len(u), kind * 100 + 2 * int(fold[a + i]) + int(y[a + i])))
            if keys:
                key, cell = np.concatenate(keys).view(np.int64), np.concatenate(cells)
                o = np.lexsort((cell, key))
                key, cell = key[o], cell[o]
                head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
                n = np.diff(np.concatenate([head, [len(key)]]))
                yield pa.RecordBatch.from_arrays([pa.array(cell[head] // 100, pa.int32()), pa.array(key[head]), pa.array(cell[head] % 100, pa.int32()), pa.array(n)], ["kind", "key", "cell", "n"])

    counts = rows.select("text", "y", "fold").mapInArrow(run, "kind int, key bigint, cell int, n bigint")
    totals = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}  # folds x 2 rows
    at = lambda f, y: F.sum(F.when(F.col("cell") == 2 * f + y, F.col("n")).otherwise(0)).cast("double")
    per = counts.groupBy("kind", "key").agg(*[at(f, y).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)])
    out = []
    for left_out in (None, *range(FOLDS)):
        use = [f for f in range(FOLDS) if f != left_out]
        pos, neg = sum(totals.get((f, 1), 0) for f in use), sum(totals.get((f, 0), 0) for f in use)
        if not pos or not neg:
            out.append([np.zeros(0, _U)] * 3)
            continue
        p1, p0 = (sum((F.col(f"n{f}{y}") for f in use), F.lit(0.0)) for y in (1, 0))
        rate = pos / (pos + neg)
        g2 = 2 * (p1 * F.log(F.greatest(p1, F.lit(1e-9)) / ((p1 + p0) * rate)) + p0 * F.log(F.greatest(p0, F.lit(1e-9)) / ((p1 + p0) * (1 - rate))))
        strong = per.where(p1 + p0 > 0).withColumn("g2", g2).where((F.col("g2") >= least) & (p1 / pos > 3 * p0 / neg))
        found = strong.select("kind", "key").collect()  # words in several toxic documents of a bounded sample
        out.append([np.unique(np.array([r["key"] for r in found if r["kind"] == k], np.int64).view(_U)) for k in range(3)])
    return out


class Model:
    def __init__(self, lexicon, trees, calibration, base: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.base)
        return np.clip(self.calibration(self.trees.raw(features(texts, self.lexicon))), 0, 1)


def fit(labelled: DataFrame, docs: DataFrame, size: int = SAMPLE, least_g2: float = LEAST_G2) -> Model:
    """labelled: (doc_id, y 0/1), rows that may be learned from; docs: (doc_id, text)."""
    from .store import Store

    chosen = sample(labelled.where("y IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").cast("int").alias("y")), size, "doc_id")
    rows = with_text(docs, chosen, "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(FOLDS)).cast("int"))
    rows = Store(docs.sparkSession).keep(rows.repartition(16, "doc_id"))
    lexicons = _learn_lexicon(rows, least_g2)

    def run(batches):
        for b in batches:
            fold = b.column(2).to_numpy()
            x = np.zeros((b.num_rows, FEATURES))
            for f in range(FOLDS):
                at = np.flatnonzero(fold == f)
                if len(at):
                    x[at] = features(b.column(0).take(pa.array(at)), lexicons[1 + f])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), x.ravel())], ["y", "fold", "x"])

    got = rows.select("text", "y", "fold", "doc_id").orderBy("doc_id").select("text", "y", "fold").mapInArrow(run, "y int, fold int, x array<double>").toArrow()  # at most `size` rows of FEATURES numbers
    y = got["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(lexicons[0], None, None, float(y.mean()) if len(y) else 0.0)
    x = np.asarray(got["x"].combine_chunks().values).reshape(-1, FEATURES)
    part = np.arange(len(y)) % 3
    held = np.zeros(len(y))
    for k in range(3):
        held[part == k] = BoostedTrees().fit(x[part != k], y[part != k]).raw(x[part == k])
    return Model(lexicons[0], BoostedTrees().fit(x, y), Isotonic().fit(held, y))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """doc_id with the model's score of every whole text."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)), pa.float64())], ["doc_id", name])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, {name} double")


def train_rows(labels: DataFrame, label: str) -> DataFrame:
    """Labels that may be learned from: crc32 of the id modulo 3 isn't 1."""
    return labels.where(split_of("doc_id", 3) != 1).select("doc_id", F.col(label).alias("y"))
