"""A Merkle manifest of a dataset: one tree a source, a root over the sources, a proof for each document.

H is the lowercase hex SHA-256 of its inputs put together, digests as hex text. A leaf is H of a
row's fields, each as its UTF-8 size, a colon and its value, or `-` if null. In a tree every FAN
consecutive nodes (the last run may be shorter, down to one) become their H, until one is left.

Nodes lie in a store on disk, not in memory:

* Leaves are hashed where the rows are read and written; texts go no further. They are dealt by
  ranges of (tree, order), sorted and written as runs, numbered by counts of the runs before.
* Each level is a folder of Parquet, made from the one below by reading it once in order: runs of
  consecutive nodes are hashed as they come; only nodes of a parent that lies across a border of
  what a task reads (FAN - 1 at each end) are shuffled. A hot source is as many runs as it needs.
* Proofs come from a merge of levels by coordinate: node p of a level lies below node p // FAN of
  the next. SPAN levels at a time meet by p // FAN**SPAN and are read in order; what is above them
  is one row for each such block, found the same way.

Rows are leaves one by one: equal rows are equal leaves, side by side. A null source is a tree of
its own and comes first; a null doc_id comes first in its tree; equal ids are ordered by their
leaves. A tree of one leaf has it as root, and an empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import bounds_of, runs
from .store import Store

FAN = 16
#: Levels that are merged at once to extract proofs.
SPAN = 3
#: Leaves of a sorted run, about.
RUN = 1 << 19
#: Rows up to which the table of runs is sent to every task.
BROADCAST_RUNS = 1 << 17

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*fields: Column) -> Column:
    """H of fields, each as size:value or -."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def tree_key(source: Column) -> Column:
    """A text that orders and tells sources apart, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


class Levels:
    """The levels of the trees of one table of leaves, level 0 first: tree, size (nodes of the tree in this level), pos, hash."""

    def __init__(self, store: Store, leaves: DataFrame, order: str, others: list[str]):
        """leaves: tree, hash, `order` and the columns `others`; a tree's leaves ascend by order, then hash."""
        self.store = store
        self.leaves, depth = self._numbered(leaves, order, others)
        self.levels = [self.leaves.select("tree", "size", "pos", "hash")]
        for _ in range(depth):
            self.levels.append(self._above(self.levels[-1]))

    def _numbered(self, leaves: DataFrame, order: str, others: list[str]) -> tuple[DataFrame, int]:
        """Leaves with pos and size, as sorted runs, and the levels above them."""
        store = self.store
        leaves = store.keep(leaves.withColumn("tie", F.monotonically_increasing_id()))  # so that any number of equal rows can be dealt out
        n = leaves.count()
        keys = ["tree", order, "hash", "tie"]
        dealt = leaves.repartitionByRange(max(1, -(-n // RUN)), *keys).sortWithinPartitions(*keys)
        sorted_runs = store.keep(dealt.select("*", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("place")))
        found = sorted_runs.groupBy("tree", "run").agg(F.count("*").alias("n"), F.min("place").alias("first"))
        before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        at = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
        starts = store.keep(found.select("tree", "run", at.alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("size")))
        most = starts.agg(F.max("size").alias("m"), F.count("*").alias("n")).first()
        small = F.broadcast(starts) if most["n"] <= BROADCAST_RUNS else starts
        rows = sorted_runs.join(small, ["tree", "run"]).select("tree", "size", (F.col("place") + F.col("shift")).alias("pos"), "hash", *others)
        depth, m = 0, most["m"] or 1
        while m > 1:
            depth, m = depth + 1, -(-m // FAN)
        return store.keep(rows), depth

    def _above(self, level: DataFrame) -> DataFrame:
        """The next level of the trees that have more than one node."""

        def run(batches):
            held = None
            for b in batches:
                whole, held = _parents(b if held is None else pa.concat_batches([held, b]))
                yield from whole
            if held is not None:
                yield _loose(held)

        schema = "tree string, size bigint, parent bigint, pos bigint, hash string"
        found = level.where("size > 1").select("tree", "size", "pos", "hash").mapInArrow(run, schema)
        found = self.store.keep(found)  # pos is null in whole parents, else it is a child's
        width = F.ceil(F.col("size") / F.lit(FAN)).cast("bigint")
        whole = found.where("pos IS NULL").select("tree", width.alias("size"), F.col("parent").alias("pos"), "hash")
        children = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        torn = found.where("pos IS NOT NULL").groupBy("tree", "size", "parent").agg(children.alias("c"))
        torn = torn.select("tree", width.alias("size"), F.col("parent").alias("pos"), F.sha2(F.concat_ws("", F.transform("c", lambda c: c["hash"])), 256).alias("hash"))
        return self.store.keep(whole.union(torn))

    def roots(self) -> DataFrame:
        """tree, root: the only node of each tree's last level."""
        return reduce(DataFrame.union, [x.where("size = 1").select("tree", F.col("hash").alias("root")) for x in self.levels])

    def paths(self, base: DataFrame | None = None, others: list[str] | None = None, at: int = 0) -> DataFrame:
        """Proofs of the nodes of level `at`: tree, pos, hash, the leaves' `others`, note, proof.

        proof has for each level up to the root the run's nodes before and after; base (tree, note,
        proof as JSON) is what follows above the root.
        """
        others = others or []
        top = len(self.levels) - 1
        block = lambda i: F.shiftright("pos", 4 * (SPAN - i)).alias("block")
        none = [F.lit(None).cast(dict(self.leaves.dtypes)[c]).alias(c) for c in others]
        parts = [(self.leaves if i == 0 else self.levels[i]).where("size > 1" if i > at else "true").select("tree", block(i - at), F.lit(i - at).alias("level"), "size", "pos", "hash", F.lit("").alias("note"), F.lit("").alias("above"), *(none if i else others)) for i in range(at, max(min(at + SPAN, top), at + 1))]
        zero = F.lit(0).cast("bigint")
        over = lambda rows, block: rows.select("tree", block.alias("block"), F.lit(-1).alias("level"), zero.alias("size"), zero.alias("pos"), F.lit("").alias("hash"), "note", F.col("proof").alias("above"), *none)
        ended = base
        if top > at + SPAN:  # one row for each block of the trees that go on there
            further = self.paths(base, None, at + SPAN).withColumn("proof", F.to_json("proof"))
            parts.append(over(further, F.col("pos")))
            ended = base and base.join(self.levels[at + SPAN].where("pos = 0").select("tree"), "tree", "left_anti")
        if ended is not None:
            parts.append(over(ended, zero))

        def run(batches):
            for t in runs(batches, "gid"):
                yield from _proofs(t, others)

        keyed = reduce(DataFrame.union, parts).select(F.xxhash64("tree", "block").alias("gid"), "*")
        dealt = keyed.repartition("gid").sortWithinPartitions("gid", "tree", "block", "level", "pos")
        types = dict(self.leaves.dtypes)
        carried = "".join(f", {c} {types[c]}" for c in others)
        return dealt.mapInArrow(run, f"tree string, pos bigint, hash string, note string{carried}, proof array<struct<before: string, after: string>>")


def _parents(b: pa.RecordBatch) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
    """Parents whose children all lie in b, the children of torn ones, and the rows of the last parent if it may go on."""
    trees, hashes, pos, size = b.column("tree"), b.column("hash"), b.column("pos").to_numpy(), b.column("size").to_numpy()
    if not len(pos):
        return [], None
    parent = pos // FAN
    goes_on = pc.equal(trees[1:], trees[:-1]).to_numpy(zero_copy_only=False) & (parent[1:] == parent[:-1]) & (pos[1:] == pos[:-1] + 1)
    starts = np.concatenate([[0], np.flatnonzero(~goes_on) + 1])
    ends = np.append(starts[1:], len(pos))
    whole = (pos[starts] % FAN == 0) & (ends - starts == np.minimum(FAN, size[starts] - pos[starts]))
    held = None
    if not whole[-1] and pos[starts[-1]] % FAN == 0:  # the next batch can complete it
        held = b.slice(starts[-1])
        starts, ends, whole = starts[:-1], ends[:-1], whole[:-1]
    out = []
    at = np.flatnonzero(whole)
    if len(at):
        offs = np.frombuffer(hashes.buffers()[1], np.int32)[hashes.offset :]
        data = memoryview(hashes.buffers()[2])
        made = [hashlib.sha256(data[offs[starts[i]] : offs[ends[i]]]).hexdigest() for i in at]  # children lie side by side
        out.append(pa.RecordBatch.from_arrays([trees.take(pa.array(starts[at])), pa.array(size[starts[at]]), pa.array(parent[starts[at]]), pa.nulls(len(at), pa.int64()), pa.array(made)], names=["tree", "size", "parent", "pos", "hash"]))
    torn = np.flatnonzero(~whole)
    if len(torn):
        out.append(_loose(b.take(pa.array(np.concatenate([np.arange(starts[i], ends[i]) for i in torn])))))
    return out, held


def _loose(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("tree"), b.column("size"), pa.array(b.column("pos").to_numpy() // FAN), b.column("pos"), b.column("hash")], names=["tree", "size", "parent", "pos", "hash"])


def _proofs(t: pa.Table, others: list[str]) -> Iterator[pa.RecordBatch]:
    """Proofs of the level-0 rows of whole blocks, sorted by tree, block, level, pos."""
    trees, level, pos, size = t["tree"].combine_chunks(), t["level"].to_numpy(), t["pos"].to_numpy(), t["size"].to_numpy()
    hashes = t["hash"].to_pylist()
    cuts = np.union1d(bounds_of(t["block"].to_numpy()), np.flatnonzero(pc.not_equal(trees[1:], trees[:-1]).to_numpy(zero_copy_only=False)) + 1)
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        lv = (np.searchsorted(level[s:e], np.arange(-1, SPAN + 1)) + s).tolist()
        a, z = lv[1], lv[2]
        if a == z:
            continue
        above, note = [], ""
        if s < a:
            note = t["note"][s].as_py()
            above = [(x.get("before", ""), x.get("after", "")) for x in json.loads(t["above"][s].as_py())]
        met = []  # of each level: first pos of the block's nodes, and its runs as one text each
        for x, y in zip(lv[1:], lv[2:]):
            if x == y or size[x] == 1:
                break
            met.append((int(pos[x]), ["".join(hashes[j : min(j + FAN, y)]) for j in range(x, y, FAN)]))
        known: dict[tuple[int, int], list] = {}

        def path(i: int, p: int) -> list:
            """Runs around node p of level i, and from there upwards."""
            if i >= len(met):
                return above
            if (i, p) not in known:
                first, joined = met[i]
                siblings, k = joined[(p - first) // FAN], (p % FAN) * 64
                known[i, p] = [(siblings[:k], siblings[k + 64 :]), *path(i + 1, p // FAN)]
            return known[i, p]

        for x in range(a, z, 256):  # a proof is some kilobytes
            y = min(x + 256, z)
            proofs = [path(0, p) for p in pos[x:y].tolist()]
            counts = np.concatenate([[0], np.cumsum([len(p) for p in proofs])]).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array([q[k] for p in proofs for q in p], pa.string()) for k in (0, 1)], ["before", "after"])
            same = [t[c].slice(x, y - x).combine_chunks() for c in ("tree", "pos", "hash")]
            yield pa.RecordBatch.from_arrays([*same, pa.array([note] * (y - x), pa.string()), *[t[c].slice(x, y - x).combine_chunks() for c in others], pa.ListArray.from_arrays(pa.array(counts), parts)], ["tree", "pos", "hash", "note", *others, "proof"])


def fold(leaf: str, proof: str) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, F.col(leaf), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def siblings(proof: str) -> Column:
    """All digests of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, changed: Column | None = None, changed_text: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof (array of before, after) of every row, and `tampered`: its leaf with
    `changed_text` instead of its text where `changed` holds, else the leaf itself."""
    store = Store(docs.sparkSession)
    fields = [F.col(c) for c in FIELDS]
    leaf = leaf_hash(*fields)
    other = leaf if changed is None else F.when(changed, leaf_hash(*fields[:-1], changed_text)).otherwise(leaf)
    leaves = docs.select(tree_key(F.col("source")).alias("tree"), leaf.alias("hash"), F.col("doc_id").cast("bigint").alias("doc_id"), F.when(other != leaf, other).otherwise("").alias("changed"))
    trees = Levels(store, leaves, "doc_id", ["doc_id", "changed"])
    subroots = trees.roots().select(F.lit("").alias("tree"), F.col("root").alias("hash"), F.col("tree").alias("of"))
    top = Levels(store, subroots, "of", ["of"])
    root = top.roots().first()
    base = store.keep(top.paths(None, ["of"]).select(F.col("of").alias("tree"), F.col("hash").alias("note"), F.to_json("proof").alias("proof")))
    rows = trees.paths(base, ["doc_id", "changed"])
    source = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    tampered = F.when(F.col("changed") != "", F.col("changed")).otherwise(F.col("hash"))
    return rows.select("doc_id", source.alias("source"), F.col("hash").alias("leaf"), tampered.alias("tampered"), F.col("note").alias("subroot"), F.lit(root and root["root"]).cast("string").alias("root"), "proof")
