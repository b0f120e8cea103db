"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Seeds: the SEED-word grams of the benchmark items (an item with fewer words is one seed).
   One pass over all documents counts in how many each seed occurs.
2. Seeds that occur nowhere go; all others stay. Rare seeds, those in at most RARE of all
   documents, are evidence by themselves.
3. Wherever a document holds a seed of an item, its words around the hits (as many as the
   item has, to either side) are aligned with the item: match 1, mismatch and gap -1/2,
   linear gaps, exact local alignment row by row. Where no hit is rare (common phrases, or
   a leak in very many documents), the item's words are counted first, and only places
   that have too few of them for the least score are passed over: no leak is lost by that.
   A pair is reported if its score reaches half of the item's length and the worth of SURE
   words (all words of a shorter item). About a third of the words may differ, and half of
   an item is enough.

The benchmark is taken in blocks of at most BLOCK_WORDS words, each sent to every task, so
what is broadcast has a fixed bound; beyond it more blocks follow, each with two passes
over the documents. Documents are never shuffled; hits never leave a task unverified.

Words are runs of letters, digits and bytes above 0x7F, A-Z lower-cased. Null and empty
texts and items match nothing; repeated rows are reported alike; of items that share an id
each is aligned, and the best score counts. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, mix64, sequence_hash, shingle_hashes, text_blocks, word_hashes

SEED = 3
RARE = 1e-4
SURE = 6
SHARE = 0.5
PENALTY = 0.5
BLOCK_WORDS = 1 << 20

_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80 for b in range(256)])


def local_alignment(item: np.ndarray, text: np.ndarray, penalty: float = PENALTY) -> tuple[float, int, int]:
    """Best Smith-Waterman score, and the (first, end) words of `text` in it."""

    def forward(a, b):
        slope = penalty * np.arange(len(b) + 1)
        h, best, end = np.zeros(len(b) + 1), 0.0, 0
        for x in a:
            c = np.zeros(len(b) + 1)
            c[1:] = np.maximum(np.maximum(h[:-1] + np.where(b == x, 1.0, -penalty), h[1:] - penalty), 0)
            h = np.maximum.accumulate(c + slope) - slope  # a gap in the item costs its length
            i = int(h.argmax())
            if h[i] > best:
                best, end = float(h[i]), i
        return best, end

    best, end = forward(item, text)
    if not best:
        return 0.0, 0, 0
    back, length = forward(item[::-1], text[:end][::-1])
    return best, end - length, end


class Index:
    """Seeds of a block of items: hash -> (item, place in the item)."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        rows = []
        for i, w in enumerate(items):
            if len(w) >= SEED:
                s, _ = shingle_hashes(w, np.array([0, len(w)]), SEED)
                rows += [(h, i, p) for p, h in enumerate(s)]
            elif len(w):
                rows.append((_short(w), i, 0))
        self.sizes = sorted({min(len(w), SEED) for w in items if len(w)})
        h = np.array([r[0] for r in rows], np.uint64)
        o = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[o], np.array([r[1] for r in rows], np.int64)[o], np.array([r[2] for r in rows], np.int64)[o]
        self.seeds, self.first = np.unique(self.hash, return_index=True)
        self.bounds = np.append(self.first, len(self.hash))
        self.rare = np.ones(len(self.seeds), bool)
        self.counts = [np.unique(w, return_counts=True) for w in items]

    def mark_rare(self, df: np.ndarray, most: float) -> None:
        """Of all seeds, by their document counts: drop those in none, mark the rare ones."""
        keep = np.repeat(df > 0, np.diff(self.bounds))
        self.hash, self.item, self.place = self.hash[keep], self.item[keep], self.place[keep]
        self.seeds, self.first = np.unique(self.hash, return_index=True)
        self.bounds = np.append(self.first, len(self.hash))
        self.rare = df[df > 0] <= most

    def may_score(self, i: int, text: np.ndarray, least: float) -> bool:
        """False only if too few words of item i are in the text for an alignment of that score."""
        known, count = self.counts[i]
        at = np.minimum(np.searchsorted(known, text), len(known) - 1)
        hit = np.flatnonzero(known[at] == text)
        need = math.ceil(least)
        if len(hit) < need or np.minimum(np.bincount(at[hit], minlength=len(known)), count).sum() < need:
            return False
        # The item's words that don't count towards the score pay for at most that many gaps.
        m = len(self.items[i])
        return bool((hit[need - 1 :] - hit[: len(hit) - need + 1] < m + (m - least) / PENALTY).any())

    def hits(self, words: np.ndarray, bounds: np.ndarray):
        """(document, place, seed) of every seed in a block's words."""
        out = []
        for n in self.sizes:
            if n == SEED:
                h, hb = shingle_hashes(words, bounds, n)
            else:  # items shorter than a seed
                hb = np.concatenate([[0], np.cumsum(np.maximum(np.diff(bounds) - n + 1, 0))])
                h = np.array([_short(words[p : p + n]) for d in range(len(bounds) - 1) for p in range(bounds[d], bounds[d + 1] - n + 1)], np.uint64)
            if not len(h) or not len(self.seeds):
                continue
            at = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
            hit = np.flatnonzero(self.seeds[at] == h)
            doc = np.searchsorted(hb, hit, "right") - 1
            out.append((doc, hit - hb[doc], at[hit]))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _short(words: np.ndarray) -> np.uint64:
    return sequence_hash(words)


def _word_blocks(column: pa.Array):
    for a, e, data, offs in text_blocks(column):
        words, bounds = word_hashes(LOWER[data], offs, _WORD)
        yield a, e, words, bounds


def _align(index: Index, words: np.ndarray, bounds: np.ndarray, share: float, sure: int):
    """(document, item, score, first word, end word) of the pairs that pass."""
    doc, place, seed = index.hits(words, bounds)
    n = np.diff(index.bounds)[seed]
    which = np.repeat(index.bounds[:-1][seed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, place, item, rare = np.repeat(doc, n), np.repeat(place, n), index.item[which], np.repeat(index.rare[seed], n)
    o = np.lexsort((place, item, doc))
    doc, place, item, rare = doc[o], place[o], item[o], rare[o]
    size = np.array([len(w) for w in index.items])[item]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] > place[:-1] + 2 * size[1:])
    start = np.flatnonzero(new)
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for s, e in zip(start, np.append(start[1:], len(doc))):
        d, i, m = int(doc[s]), int(item[s]), int(size[s])
        lo, least = max(0, int(place[s]) - m - m // 2), max(share * m, min(m, sure))
        text = words[bounds[d] : bounds[d + 1]][lo : int(place[e - 1]) + SEED + m + m // 2]
        if not rare[s:e].any() and not index.may_score(i, text, least):
            continue
        score, x, y = local_alignment(index.items[i], text)
        if score >= least and score > found.get((d, i), (0.0,))[0]:
            found[d, i] = (score, lo + x, lo + y)
    return [(d, i, *v) for (d, i), v in found.items()]


def _indexes(docs: DataFrame, benchmark: DataFrame, rare: float, block_words: int):
    """(item ids, Index with its rare seeds marked) of each block of the benchmark."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()  # some block_words words
        index = Index([w[bounds[i] : bounds[i + 1]] for a, e, w, bounds in _word_blocks(part["text"]) for i in range(e - a)])
        _count_seeds(docs, index, rare)
        yield part["item_id"].to_numpy(), index


def _count_seeds(docs: DataFrame, index: Index, rare: float) -> None:
    """Document counts of the index's seeds over all docs; it marks the rare ones."""

    def count(batches):
        df, n = np.zeros(len(index.seeds), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, _, words, bounds in _word_blocks(b.column(0)):
                doc, _, seed = index.hits(words, bounds)
                df += np.bincount(np.unique(doc * (len(df) + 1) + seed) % (len(df) + 1), minlength=len(df))[: len(df)]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["seed", "n"])

    counts = docs.select("text").mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # at most one row a seed of this block
    df, total = np.zeros(len(index.seeds)), 0
    for seed, n in zip(counts["seed"].to_pylist(), counts["n"].to_pylist()):
        if seed < 0:
            total = n
        else:
            df[seed] = n
    index.mark_rare(df, max(1.0, rare * total))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, sure: int = SURE, rare: float = RARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score (share of the item's length), first_word, end_word of every leak."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def aligner(ids, index):
        def align(batches):
            for b in batches:
                rows = [(a, *x) for a, _, words, bounds in _word_blocks(b.column(1)) for x in _align(index, words, bounds, share, sure)]
                at = pa.array([r[0] + r[1] for r in rows], pa.int64())
                item = np.array([r[2] for r in rows], np.int64)
                size = np.array([len(index.items[i]) for i in item], float)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), pa.array(ids[item].astype(np.int64)), pa.array(np.array([r[3] for r in rows], float) / size), *(pa.array([r[c] for r in rows], pa.int64()) for c in (4, 5))],
                    ["doc_id", "item_id", "score", "first_word", "end_word"],
                )

        return align

    out = [docs.mapInArrow(aligner(ids, index), "doc_id bigint, item_id bigint, score double, first_word bigint, end_word bigint") for ids, index in _indexes(docs, benchmark, rare, block_words)]
    found = reduce(DataFrame.union, out)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "end_word")).alias("m")).select("doc_id", "item_id", "m.score", "m.first_word", "m.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, sure: int = SURE, rare: float = RARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that leak no item, with all their columns; decided row by row, without a join."""
    at = docs.columns.index("text")

    def cleaner(index):
        def clean(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for a, _, words, bounds in _word_blocks(b.column(at)):
                    keep[[a + x[0] for x in _align(index, words, bounds, share, sure)]] = False
                yield b.filter(pa.array(keep))

        return clean

    return reduce(lambda d, x: d.mapInArrow(cleaner(x[1]), docs.schema), _indexes(docs, benchmark, rare, block_words), docs)
