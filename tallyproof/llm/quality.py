"""Quality by positive-unlabelled learning: non-negative unbiased risk.

Only trusted positives and unlabelled text are learned from, never negative labels.

* Features: rates of characters, words and repetition over the whole text.
* Class prior: the share of positives in unlabelled text is at most the unlabelled over the
  positive rate of any region. Boosted trees tell positives from unlabelled text (scored
  out of fold), and the least U(t) / P(t) over their upper regions {score >= t} estimates
  it. An estimate a little low does no harm, while one too high makes the negative part of
  the risk negative and stops the classifier from telling the negatives, so no margin is
  added.
* Classifier: a network of one hidden layer g, minimising
  prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) with the logistic loss l.
  Where a batch's negative part falls below zero, its gradient is reversed, as in
  non-negative PU learning.

The score is the network's probability. Fitted on at most SAMPLE positives and SAMPLE
unlabelled ids (the first by a hash of the id; of rows that share an id, one), both from rows that may be learned from;
applied to every row. Without positives all scores are 0.5. Null and empty texts have
zeros for features; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample, split_of, with_text
from .trees import BoostedTrees
from .words import LOWER, WORD_BYTES, mix64, text_blocks, token_spans, word_hashes

SAMPLE = 8_000
THRESHOLD = 0.5
FEATURES = 24

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_PLAIN_PUNCT = np.array([chr(b) in ".,;:'\"-()" if b < 128 else False for b in range(256)])
_SIGN = np.array([33 <= b <= 126 and not (_LETTER[b] or _DIGIT[b] or _PLAIN_PUNCT[b]) for b in range(256)])


def _distinct(keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct keys, and the count of its most frequent key."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    o = np.lexsort((keys, of))
    k, d = keys[o], of[o]
    head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]))
    count = np.diff(np.concatenate([head, [len(k)]]))
    top = np.zeros(n)
    np.maximum.at(top, d[head], count)
    return np.bincount(d[head], minlength=n).astype(float), top


def features(column: pa.Array) -> np.ndarray:
    parts = [np.zeros((0, FEATURES))]
    for a, e, data, offs in text_blocks(column):
        n, size = e - a, np.diff(offs)
        total = np.maximum(size, 1)
        lower = LOWER[data]
        start, end = token_spans(data, offs, WORD_BYTES)
        words, bounds = word_hashes(lower, offs)
        nw = np.diff(bounds)
        of = np.repeat(np.arange(n), nw)
        w = np.maximum(nw, 1)
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
        cum = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        per = lambda x: np.bincount(of, x, n)
        length = end - start
        letters, signs, uppers = (c[end] - c[start] for c in (cum(_LETTER[data]), cum(_SIGN[data]), cum(_UPPER[data])))
        uniq, top = _distinct(words, of, n)
        pair = mix64(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
        inside = of[:-1] == of[1:] if len(of) > 1 else np.zeros(0, bool)
        pairs = np.bincount(of[:-1][inside], minlength=n) if len(of) > 1 else np.zeros(n)
        upair, tpair = _distinct(pair[inside], of[:-1][inside] if len(of) > 1 else of, n)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1]) if len(words) > 1 else False
        line_end = data == 10
        starts_line = np.concatenate([[True], line_end])[: len(data)]
        starts_line[offs[:-1][size > 0]] = True
        l_start = np.flatnonzero(starts_line & ~line_end)
        l_of = np.searchsorted(offs, l_start, "right") - 1
        lines = np.bincount(l_of, minlength=n)
        sentence = (data == 46) | (data == 63) | (data == 33)
        double = np.zeros(len(data), bool)
        double[1:] = _SIGN[data][1:] & (data[1:] == data[:-1])
        x = np.stack(
            [
                count(_UPPER[data]) / total, count(_SIGN[data]) / total, count(_DIGIT[data]) / total, count(_PLAIN_PUNCT[data]) / total,
                count(data >= 0x80) / total, count(double) / total, count(data == 33) / total, count(data == 124) / total,
                per((uppers == letters) & (letters > 1)) / w, per(signs > 0) / w, per(letters == 0) / w, per(length > 20) / w,
                per(length) / w, np.sqrt(np.maximum(per(length**2) / w - (per(length) / w) ** 2, 0)), per(length <= 3) / w,
                uniq / w, top / w, upair / np.maximum(pairs, 1), tpair / np.maximum(pairs, 1), per(again) / w,
                count(sentence) / w, lines / w, np.log1p(nw), np.log1p(uniq),
            ],
            1,
        )
        x[size == 0] = 0
        parts.append(x)
    return np.concatenate(parts)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The estimated share of positives among the unlabelled rows."""
    x = np.concatenate([positive, unlabelled])
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(unlabelled))])
    part, held = np.arange(len(y)) % 2, np.zeros(len(y))
    for k in (0, 1):
        held[part == k] = BoostedTrees(trees=30, least=20).fit(x[part != k], y[part != k]).raw(x[part == k])
    p, u = np.sort(held[y == 1]), np.sort(held[y == 0])
    t = np.quantile(p, np.linspace(0, 0.5, 101))  # regions that hold at least half of the positives
    above = lambda s: 1 - np.searchsorted(s, t, "left") / len(s)
    return float(np.clip(np.min(above(u) / np.maximum(above(p), 0.05)), 0.05, 0.99))


class Network:
    """One hidden layer; fitted by Adam on the non-negative risk."""

    def __init__(self, hidden: int = 24, epochs: int = 120, batch: int = 1000, rate: float = 0.01, decay: float = 1e-4):
        self.hidden, self.epochs, self.batch, self.rate, self.decay = hidden, epochs, batch, rate, decay

    def _prepare(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _forward(self, x):
        h = np.tanh(x @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
        rng = np.random.default_rng(5)
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-6
        p, u = self._prepare(positive), self._prepare(unlabelled)
        d = p.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        steps = max(1, len(u) // self.batch)
        for _ in range(self.epochs):
            ps, us = np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps)
            for pi, ui in zip(ps, us):
                if not len(pi) or not len(ui):
                    continue
                x = np.concatenate([p[pi], u[ui]])
                is_p = np.arange(len(x)) < len(pi)
                h, g = self._forward(x)
                loss = lambda z: np.logaddexp(0, -z)
                negative = loss(-g[~is_p]).mean() - prior * loss(-g[is_p]).mean()
                # Gradients of the risk's two parts with respect to g.
                up = np.where(is_p, -prior * sig(-g) / len(pi), 0.0)
                down = np.where(is_p, -prior * sig(g) / len(pi), sig(g) / len(ui))
                dg = up + down if negative >= 0 else -down
                dh = np.outer(dg, self.w[2]) * (1 - h * h)
                grads = [x.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()])]
                t += 1
                for k, grad in enumerate(grads):
                    grad = grad + self.decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    self.w[k] = self.w[k] - self.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(self._prepare(features(texts)))[1], -30, 30)))


class Constant:
    def score(self, texts: pa.Array) -> np.ndarray:
        return np.full(len(texts), 0.5)


def fit(positives: DataFrame, docs: DataFrame, size: int = SAMPLE) -> Network | Constant:
    """positives: (doc_id) of trusted good rows; docs: (doc_id, text); both only rows that may be learned from."""
    trusted = sample(positives.where("doc_id IS NOT NULL").select("doc_id").distinct(), size, "doc_id").withColumn("trusted", F.lit(True))
    web = sample(docs.where("doc_id IS NOT NULL").select("doc_id").distinct(), size, "doc_id").withColumn("web", F.lit(True))
    chosen = trusted.join(web, "doc_id", "full")

    def run(batches):
        for b in batches:
            x = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), x.ravel())], ["doc_id", "trusted", "web", "x"])

    rows = with_text(docs, chosen, "doc_id").select("doc_id", "text", "trusted", "web")
    got = rows.mapInArrow(run, "doc_id bigint, trusted boolean, web boolean, x array<double>").orderBy("doc_id").toArrow()  # at most 2 * size rows of FEATURES numbers
    x = np.asarray(got["x"].combine_chunks().values, float).reshape(-1, FEATURES)
    is_p, is_u = (got[c].fill_null(False).to_numpy() for c in ("trusted", "web"))
    if is_p.sum() < 2 or is_u.sum() < 2:
        return Constant()
    return Network().fit(x[is_p], x[is_u], class_prior(x[is_p], x[is_u]))


def score(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """doc_id with the score of every whole text."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)), pa.float64())], ["doc_id", name])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, {name} double")


def keep_good(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose whole text scores at least the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def fit_on_tables(docs: DataFrame, labels: DataFrame, size: int = SAMPLE):
    """The classifier from a documents and a labels table, by the split that may be learned from."""
    may = split_of("doc_id", 3) != 1
    return fit(labels.where(may & (F.col("quality") == 1)), docs.where(may), size)
