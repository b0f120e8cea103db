"""Near-duplicate documents by MinHash with tensored banding, and links confirmed on full sets.

Plain banding needs a fresh group of minhashes for each of its L tables. Tensored
banding draws two small collections of groups, LEFT and RIGHT, with sqrt(L) groups each;
the key of table (i, j) is the pair (left group i, right group j), so L tables cost only
2 * sqrt(L) groups of minhashes. Here 14 + 14 groups of 4 minhashes make 196 tables of 8
minhashes out of 112 instead of 1568; a pair at Jaccard 0.85 shares no table with a
probability of 7e-5 (at 0.9: 6e-7).

Steps, all distributed:

1. One pass over the texts gives each document its set size, a 128-bit set hash (of two
   independent hashes of each word) and its 28 group keys. Equal sets become one
   representative (partial aggregation, so a group of a third of all rows is no problem).
2. Left keys held by one representative alone can form no table key that two share; only
   the others are expanded with their right keys (i, j).
3. Within a table key, members link to its most popular member. Members and centre meet in
   groups of bounded size (a hot centre has many), with the centre's text once a group, and
   a link is confirmed on the full sets of shingles, compared by their words. Connected
   components follow. Table keys whose members are already one component are done. Where a
   table key still holds different components, the members meet in blocks and their
   remaining pairs are confirmed there, so no link between components is lost, and only
   links that join two components of a group become rows.

Nulls and empties: null or wordless text has an empty set, links with nothing and is its
own component. Fewer than `size` words: the whole sequence is one shingle. Rows with a
null doc_id link with nothing (component_id null, kept true). Rows that share a doc_id
count as one document, which has the links of all its texts; each row is returned. Very
long texts are handled whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .groups import bounds_of, runs, with_blocks
from .store import Store
from .words import LOWER, WORD_BYTES, mix64, sequence_hash, shingle_hashes, text_blocks, token_spans, word_hashes

COLLECTIONS = 14
GROUP = 4


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's sorted distinct shingle hashes, and second hashes of the same shingles, in row order."""
    for a, e, data, offs in text_blocks(column):
        data = LOWER[data]
        words, bounds = word_hashes(data, offs)
        again, _ = word_hashes(data, offs, salt=1)
        (sh, sb), (second, _) = shingle_hashes(words, bounds, size), shingle_hashes(again, bounds, size)
        for i in range(e - a):
            n = bounds[i + 1] - bounds[i]
            if n >= size:
                u, at = np.unique(sh[sb[i] : sb[i + 1]], return_index=True)
                yield u, second[sb[i] : sb[i + 1]][at]
            elif n:
                yield tuple(np.array([sequence_hash(w[bounds[i] : bounds[i + 1]])]) for w in (words, again))
            else:
                yield np.zeros(0, np.uint64), np.zeros(0, np.uint64)


class ExactSets:
    """The sets of shingles of a column of texts, compared by their words.

    Words are numbered by a dictionary of their bytes, runs of words by sorting pairs of
    numbers. `keys` is sorted: text * base + shingle; `bounds` are its ranges by text.
    """

    def __init__(self, column: pa.Array, size: int):
        code, of, n = _numbered(column, size)
        self.base = len(code) + 1
        self.keys = np.unique(of * self.base + code)
        self.bounds = np.searchsorted(self.keys, np.arange(n + 1) * self.base)
        self.sizes = np.diff(self.bounds)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pairs of texts (a, b), none of them empty."""
        out = np.zeros(len(a), np.int64)
        done, ends = 0, np.cumsum(self.sizes[b])
        while done < len(a):  # about a million shingles at once
            to = max(done + 1, int(np.searchsorted(ends, ends[done] + (1 << 20))))
            n = self.sizes[b[done:to]]
            first = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(self.bounds[b[done:to]] - first, n)
            want = self.keys[at] + np.repeat((a[done:to] - b[done:to]) * self.base, n)
            hit = self.keys[np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)] == want
            out[done:to] = np.add.reduceat(hit.astype(np.int64), first)
            done = to
        return out


def _numbered(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of all shingles of a column, the text of each, and the number of texts."""
    chunks, counts = [], [np.zeros(0, np.int64)]
    for _, _, data, offs in text_blocks(column):
        data = LOWER[data]
        start, end = token_spans(data, offs, WORD_BYTES)
        stop = np.cumsum(end - start)
        raw = data[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - (end - start)), end - start)]
        chunks.append(pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], stop])), pa.py_buffer(raw)]))
        counts.append(np.diff(np.searchsorted(start, offs)))
    n = np.concatenate(counts)
    ids = np.concatenate([np.zeros(0, np.int64), *(c.indices.to_numpy() + 1 for c in pa.chunked_array(chunks, pa.large_binary()).dictionary_encode().chunks)])
    # Shorter texts are filled up with zeros to one run.
    room = np.where(n > 0, np.maximum(n, size), 0)
    first = np.cumsum(room) - room
    place = np.arange(len(ids)) + np.repeat(first - (np.cumsum(n) - n), n)
    padded = np.zeros(int(room.sum()), np.int64)
    padded[place] = ids
    count = np.where(n > 0, room - size + 1, 0)
    at = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
    code, base = padded[at], int(ids.max(initial=0)) + 1
    for k in range(1, size):
        code = np.unique(code * base + padded[at + k], return_inverse=True)[1]
    return code, np.repeat(np.arange(len(n)), count), len(n)


def _signatures(sets: list[tuple[np.ndarray, np.ndarray]], collections: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: set hashes (n, 2) and group keys (n, 2 * collections), as int64."""
    flat, second = (np.concatenate([s[k] for s in sets]) for k in (0, 1))
    starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in sets])[:-1]])
    with np.errstate(over="ignore"):
        whole = np.stack([np.add.reduceat(mix64(x, salt), starts) for x, salt in ((flat, 3), (second, 4))], 1)
        x = (flat >> np.uint64(32)).astype(np.uint32)
        n = 2 * collections * group
        draws = mix64(np.arange(2 * n, dtype=np.uint64), 21).astype(np.uint32)
        keys = np.zeros((len(sets), 2 * collections), np.uint64)
        for k in range(n):
            low = np.minimum.reduceat(x * (draws[k] | np.uint32(1)) ^ draws[n + k], starts)
            keys[:, k // group] = mix64(keys[:, k // group] + low.astype(np.uint64), 31 + k)
    return whole.view(np.int64), keys.view(np.int64)


SIGNATURE = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, lefts array<bigint>, rights array<bigint>"


def signatures(docs: DataFrame, size: int, collections: int, group: int) -> DataFrame:
    """One row per row of docs (doc_id, text); h1, h2 and keys are null for empty sets."""

    def run(batches):
        lists = lambda v: pa.ListArray.from_arrays(np.arange(0, v.size + 1, collections, dtype=np.int32), v.ravel())
        for b in batches:
            ids, pending, rows = b.column(0), [], []
            made: list[tuple[list[int], np.ndarray, np.ndarray]] = []
            sizes = np.zeros(len(ids), np.int64)

            def flush():
                if pending:
                    made.append((rows[:], *_signatures(pending, collections, group)))
                    pending.clear(), rows.clear()

            held = 0
            for i, s in enumerate(shingle_sets(b.column(1), size)):
                sizes[i] = len(s[0])
                if len(s[0]):
                    pending.append(s), rows.append(i)
                    held += len(s[0])
                    if held > 1 << 17:
                        flush()
                        held = 0
            flush()
            full = np.array([r for x in made for r in x[0]], np.int64)
            empty = np.flatnonzero(sizes == 0)
            if len(full):
                whole, keys = np.concatenate([x[1] for x in made]), np.concatenate([x[2] for x in made])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(full)), pa.array(sizes[full]), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), lists(keys[:, :collections].copy()), lists(keys[:, collections:].copy())],
                    ["doc_id", "n_shingles", "h1", "h2", "lefts", "rights"],
                )
            if len(empty):
                none = lambda t: pa.nulls(len(empty), t)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(empty)), pa.array(sizes[empty]), none(pa.int64()), none(pa.int64()), none(pa.list_(pa.int64())), none(pa.list_(pa.int64()))], ["doc_id", "n_shingles", "h1", "h2", "lefts", "rights"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SIGNATURE)


#: Shingles (and some for each text) that meet in one block; more are dealt to more blocks.
BLOCK = 1 << 16
_WEIGHT = "n_shingles + 200"
_LINK = "a bigint, b bigint"


def _links(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, threshold: int, block: int) -> DataFrame:
    """Of pairs (centre, node, n_shingles), the links: 100 * |intersection| >= threshold * |union|."""
    dealt = with_blocks(pairs, "centre", "node", F.expr(_WEIGHT), block)
    dealt = dealt.select(F.xxhash64("centre", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("gid"), "centre", "node")
    members = dealt.join(texts.withColumnRenamed("doc_id", "node"), "node").select("gid", "centre", "node", "text")
    centres = dealt.select("gid", "centre").distinct().join(texts.withColumnRenamed("doc_id", "centre"), "centre").select("gid", "centre", F.lit(None).cast("bigint").alias("node"), "text")

    def run(batches):
        for t in runs(batches, "gid"):
            gid, centre, node = t["gid"].to_numpy(), t["centre"].to_numpy(), t["node"]
            sets = ExactSets(t["text"], size)
            is_member = node.is_valid().to_numpy()
            node, n = node.fill_null(0).to_numpy(), sets.sizes
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            bounds = bounds_of(gid)
            for i in np.flatnonzero(~is_member & (n > 0)):
                k = np.searchsorted(bounds, i, "right")
                at = np.arange(bounds[k - 1], bounds[k])
                b.append(at[is_member[at] & (centre[at] == centre[i]) & (n[at] > 0)])
                a.append(np.full(len(b[-1]), i))
            a, b = np.concatenate(a), np.concatenate(b)
            common = sets.common(a, b)
            hit = 100 * common >= threshold * (n[a] + n[b] - common)
            yield _links(centre[a[hit]], node[b[hit]])

    return members.union(centres).repartition("gid").sortWithinPartitions("gid").mapInArrow(run, _LINK).distinct()


def _confirm_in_blocks(rest: DataFrame, reps: DataFrame, texts: DataFrame, size: int, threshold: int, block: int) -> DataFrame:
    """Links (a, b) between members of different labels that share a table key.

    rest: (left, node, label, n_shingles). The members of a left key are dealt to blocks by a
    hash of their id, and every two blocks meet in one group, so a group has a bounded size
    however large the key is. A pair is compared only where it meets first, under its first
    shared left key, and if it shares a right key too. Of a group's links leave only those
    that join two of its components.
    """
    dealt = with_blocks(rest, "left", "node", F.expr(_WEIGHT), block)
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("gid", F.xxhash64("left", F.least("p", "q"), F.greatest("p", "q"))).select("gid", "left", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "p", "node", "label")
    rows = dealt.join(reps.select(F.col("doc_id").alias("node"), "lefts", "rights"), "node").join(texts.withColumnRenamed("doc_id", "node"), "node")

    def run(batches):
        for t in runs(batches, "gid"):
            lefts, rights = (np.concatenate([np.asarray(c.flatten()) for c in t[k].chunks]).reshape(t.num_rows, -1) for k in ("lefts", "rights"))
            gid, left, p, lo, hi, node, label = (t[c].to_numpy() for c in ("gid", "left", "p", "lo", "hi", "node", "label"))
            sets = ExactSets(t["text"], size)
            n, out = sets.sizes, []
            first = np.argmax(lefts == left[:, None], 1)  # each row's place of this left key
            bounds = bounds_of(gid)
            for s, e in zip(bounds[:-1], bounds[1:]):
                part = np.unique(label[s:e], return_inverse=True)[1]  # what the group's links join so far
                for i in range(s, e):
                    near = (part != part[i - s]) & (n[s:e] > 0) & (100 * np.minimum(n[s:e], n[i]) >= threshold * np.maximum(n[s:e], n[i])) & (node[s:e] > node[i])
                    near &= (p[s:e] != p[i]) if lo[i] != hi[i] else True
                    near = s + np.flatnonzero(near & (n[i] > 0))
                    near = near[(rights[near] == rights[i]).any(1)]
                    near = near[np.argmax(lefts[near] == lefts[i], 1) == first[i]]
                    if not len(near):
                        continue
                    common = sets.common(np.full(len(near), i), near)
                    for j in near[100 * common >= threshold * (n[i] + n[near] - common)]:
                        if part[j - s] != part[i - s]:
                            out.append((node[i], node[j]))
                            part[part == part[j - s]] = part[i - s]
            yield _links([x for x, _ in out], [y for _, y in out])

    return rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, _LINK).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 85, collections: int = COLLECTIONS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept. See the module's text.

    size: words of a shingle; threshold: least Jaccard similarity of a link, in percent;
    collections, group: groups in each of the two collections, and minhashes in a group;
    block: shingles that meet in one group.
    """
    store = Store(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sigs = store.keep(signatures(docs, size, collections, group))
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    ids = store.keep(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # A representative's keys come from its own row, so only 16 bytes a set pass the aggregation.
    reps = store.keep(full.join(ids.select("h1", "h2", F.col("rep").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"]))
    # Of a doc_id with several texts, the representatives are linked.
    several = full.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc_id")
    own = full.join(several, "doc_id", "left_semi").join(ids, ["h1", "h2", "n_shingles"]).select("doc_id", "rep")
    pooled = own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    lefts = reps.select("doc_id", F.explode("lefts").alias("left"))
    lefts_shared = lefts.groupBy("left").agg(F.count("*").alias("n")).where("n > 1").select("left")
    live = lefts.join(lefts_shared, "left")
    rights = reps.select("doc_id", "n_shingles", "rights")
    tables = live.join(rights, "doc_id").select(F.col("doc_id").alias("node"), "n_shingles", "left", F.explode("rights").alias("right")).select("node", "n_shingles", "left", F.xxhash64("left", "right").alias("key"))
    tables = store.keep(tables)
    shared = tables.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key", "n")
    tables = store.keep(tables.join(shared, "key"))

    candidates = tables.select(F.col("node").alias("doc_id")).distinct()
    texts = store.keep(docs.join(candidates, "doc_id", "left_semi"))

    popular = tables.groupBy("node").agg(F.sum("n").alias("weight"))
    centres = tables.join(popular, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"), F.col("n_shingles").alias("nc"))).alias("c")).select("key", (-F.col("c.node")).alias("centre"), F.col("c.nc").alias("nc"))
    near = F.expr(f"100 * least(n_shingles, nc) >= {threshold} * greatest(n_shingles, nc)")
    first = tables.join(centres, "key").where("node <> centre").where(near).select("centre", "node", "n_shingles").distinct()
    edges = store.keep(_confirm(store.keep(first), texts, size, threshold, block).union(pooled))
    labels = store.keep(components(edges, store))

    # Table keys that still hold members of different components: the rest of their pairs, in blocks.
    marked = tables.join(labels, "node", "left").select("key", "left", "node", "n_shingles", F.coalesce("label", "node").alias("label"))
    split = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    rest = store.keep(marked.join(split, "key", "left_semi").select("left", "node", "label", "n_shingles").distinct())
    more = store.keep(_confirm_in_blocks(rest, reps, texts, size, threshold, block))
    if not more.isEmpty():
        labels = store.keep(components(edges.union(more), store))

    classes = ids.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("label", "rep").alias("class_id"))
    out = sigs.join(classes, ["h1", "h2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("class_id")), "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
