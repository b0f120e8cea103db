"""Language identification with a blended-spectrum string kernel.

Two texts are compared by the n-grams (2 to 4 bytes of UTF-8, A-Z lower-cased, any white
space byte as a space) that both contain: k(x, y) = |x and y| / sqrt(|x| |y|), presence only. Grams are
hashed to SLOTS places.

Nyström: the kernel is evaluated against LANDMARKS texts only, spread evenly over the
languages, and one kernel ridge regression per language (target 1 for its texts, -1 for
others) is solved over these columns in closed form. A batch of texts is scored by two
matrix products: presence (texts x slots) by landmarks' presence, scaled by the norms, then
by the weights. The language of the largest response wins; the score is its softmax.

Fitted on at most SAMPLE labelled rows a run (the first by a hash of the id, evenly over
languages, of which the first SAMPLE can be told); of rows that share id and language one is
learned from. Applied to every whole text. `und` for texts without a letter (null and empty
ones too), with score 0. Without training rows all are `und`. Ties: the language first in
code-point order. Repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample_evenly, with_text
from .words import LOWER, mix64, text_blocks

SLOTS = 1 << 16
LANDMARKS = 96
SAMPLE = 3_000
RIDGE = 1e-2
BATCH = 64
_MARK = regex.compile(r"\p{L}")

#: Bytes as the kernel sees them: lower case, and all white space as a space.
_SEEN = LOWER.copy()
_SEEN[[9, 10, 11, 12, 13]] = 32
_ASCII_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_VALUE = mix64(np.arange(256, dtype=np.uint64), 77)


def presence(column: pa.Array):
    """Blocks of (first row, end row, slots, bounds by row, has a letter): each text's distinct slots."""
    seen_at = np.zeros(SLOTS, np.int32)
    for a, e, data, offs in text_blocks(column):
        text = _SEEN[data]
        v = _VALUE[text]
        slots, of = [], []
        cut = np.repeat(np.arange(e - a), np.diff(offs))
        with np.errstate(over="ignore"):
            h = v.copy()
            for n in (2, 3, 4):
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + v[n - 1 :] if len(h) > 1 else h[:0]
                inside = cut[: len(h)] == cut[n - 1 :] if len(h) else np.zeros(0, bool)
                slots.append((mix64(h, n) >> np.uint64(48)).astype(np.int32)[inside])
                of.append(cut[: len(h)][inside])
        slot, doc = np.concatenate(slots), np.concatenate(of)
        o = np.argsort(doc, kind="stable")
        slot, doc = slot[o], doc[o]
        bounds = np.searchsorted(doc, np.arange(e - a + 1))
        letters = np.diff(np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[offs]) > 0
        out, sizes = [], np.zeros(e - a + 1, np.int64)
        for i in range(e - a):
            s = slot[bounds[i] : bounds[i + 1]]
            index = np.arange(len(s), dtype=np.int32)
            seen_at[s] = index  # of equal slots the last one written stays
            u = s[seen_at[s] == index]
            out.append(u)
            sizes[i + 1] = len(u)
            if not letters[i] and len(u):
                letters[i] = bool(_MARK.search(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
        if not letters.all():  # texts of one byte or code point have no gram
            for i in np.flatnonzero(~letters & (sizes[1:] == 0)):
                letters[i] = bool(_MARK.search(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
        yield a, e, np.concatenate([*out, np.zeros(0, np.int32)]), np.cumsum(sizes), letters


class Model:
    def __init__(self, languages: list[str], landmarks: np.ndarray | None, weights: np.ndarray | None):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def kernel(self, slots: np.ndarray, bounds: np.ndarray, a: int, e: int) -> np.ndarray:
        """Rows a to e of a block against the landmarks: one matrix product."""
        x = np.zeros((e - a, SLOTS), np.float32)
        x[np.repeat(np.arange(e - a), np.diff(bounds[a : e + 1])), slots[bounds[a] : bounds[e]]] = 1
        return (x @ self.landmarks) / np.sqrt(np.maximum(np.diff(bounds[a : e + 1]), 1))[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, score = [], np.zeros(len(texts))
        for a, e, slots, bounds, letters in presence(texts):
            for x in range(0, e - a, BATCH):
                y = min(x + BATCH, e - a)
                if self.weights is None:
                    names += ["und"] * (y - x)
                    continue
                f = 4 * (self.kernel(slots, bounds, x, y) @ self.weights)
                best = f.argmax(1)
                p = 1 / np.exp(f - f.max(1, keepdims=True)).sum(1)
                names += [self.languages[b] if ok else "und" for b, ok in zip(best, letters[x:y])]
                score[a + x : a + y] = np.where(letters[x:y], p, 0.0)
        return names, score


def fit(rows: DataFrame, size: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """rows: (doc_id, text, lang), only rows that may be learned from; null langs are left out."""
    known = rows.where("lang IS NOT NULL AND doc_id IS NOT NULL")

    def run(batches):
        for b in batches:
            for a, e, slots, bounds, _ in presence(b.column(2)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), b.column(1).slice(a, e - a), pa.ListArray.from_arrays(bounds.astype(np.int32), slots)], ["doc_id", "lang", "slots"])

    got = with_text(known, sample_evenly(known, size, "lang", "doc_id"), "doc_id", "lang").select("doc_id", "lang", "text")
    table = got.mapInArrow(run, "doc_id bigint, lang string, slots array<int>").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").toArrow()  # at most `size` rows of up to SLOTS numbers
    langs = sorted(set(table["lang"].to_pylist()))
    if not langs:
        return Model([], None, None)
    lang = np.array(table["lang"].to_pylist(), object)
    lists = table["slots"].combine_chunks()
    slots, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
    index = {x: i for i, x in enumerate(langs)}
    target = np.array([index[x] for x in lang])
    marks = np.concatenate([np.flatnonzero(target == i)[: max(2, landmarks // len(langs))] for i in range(len(langs))])
    columns = np.zeros((SLOTS, len(marks)), np.float32)
    for j, i in enumerate(marks):
        s = slots[bounds[i] : bounds[i + 1]]
        columns[s, j] = 1 / np.sqrt(max(len(s), 1))
    model = Model(langs, columns, None)
    k = np.concatenate([model.kernel(slots, bounds, a, min(a + BATCH, len(lang))) for a in range(0, len(lang), BATCH)]).astype(float)
    y = np.where(target[:, None] == np.arange(len(langs)), 1.0, -1.0)
    # Every language has the same weight in the squared loss.
    w = (len(lang) / (len(langs) * np.bincount(target, minlength=len(langs))))[target][:, None]
    model.weights = np.linalg.solve(k.T @ (w * k) + RIDGE * (k[marks] + 1e-3 * np.eye(len(marks))), k.T @ (w * y))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""

    def run(batches):
        for b in batches:
            names, score = model.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
