"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors become integers, floor(scale * x). Candidates are dealt to blocks of some BLOCK rows
by a hash of their id, queries to groups of some GROUP; every block meets every group once.
In a block each dimension has its rows sorted by that component. For a query the lists are
read, from the top where its weight is positive and from the bottom where it is negative, in
step but for those of least weight, which are read only if the stop needs them; every row met
is scored in full. Reading stops as soon as no unseen row can beat the kth score. Depths grow
by READ from round to round; a query that no depth ends has met all rows of the block.

The bound: an unseen row's component d is at most u_d (the value at the depth, taken along
the weight's sign), so it adds at most |q_d| u_d; over any dimensions T, it adds at most the
norm of q in T times the largest norm of a row. The bound is the least sum of both kinds over
the dimensions ordered by u_d / |q_d|; plain sums of |q_d| u_d are one of them.

The kth score to beat is shared: a first block is searched by all queries, and each takes its
kth score there into the other blocks. The best k of each block meet in one ranking per
query, limited to k rows before the shuffle.

Ties go to the smaller id, so equal scores at the bound are still read. Vectors that are
null or hold null or non-finite components take no part, nor do rows with a null id;
shorter vectors count as padded with zeros. A query's own id is never its candidate. Each
row of a repeated id is a candidate; repeated query rows count once, and different vectors
of one query id compete in its ranking. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import bounds_of, runs
from .store import Store

BLOCK = 16_384
GROUP = 65_536
READ = 4


def integer_vectors(table: DataFrame, scale: int = 64, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>) of the rows that take part."""
    ok = F.col(id).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.where(ok).select(F.col(id).cast("bigint").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy()[offs[0] : offs[-1]]
    out = np.zeros((len(lists), width), np.int64)
    n = np.diff(offs)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], n)] = flat
    return out


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:  # only what reaches the kth score needs an order
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, rows = scores[at], rows[at]
    o = np.lexsort((rows, -scores))[:k]
    return rows[o], scores[o]


def _bound(weight: np.ndarray, most: np.ndarray, norm: float) -> float:
    """Greatest score of a row with components (along the weights' signs) up to `most` and a norm up to `norm`."""
    o = np.argsort(most / weight)
    boxed = np.concatenate([[0.0], np.cumsum(weight[o] * most[o])])
    free = np.concatenate([np.cumsum(weight[o][::-1] ** 2)[::-1], [0.0]])
    return float((boxed + norm * np.sqrt(free)).min())


def threshold_top_k(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None, first_depth: int = 8):
    """For each query the block's best k rows, as (query index, row indexes, scores, rows scored); ids ascend.

    least: a score of each query that k rows elsewhere reach; rows below it are left out.
    """
    n, d = v.shape
    least = np.full(len(q), -np.inf) if least is None else least
    greatest = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * d
    kind = np.float32 if greatest < 2**24 else np.float64 if greatest < 2**53 else np.int64  # which hold these integers exactly
    v, q = v.astype(kind), q.astype(kind)
    order = np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").T)
    ranked = np.take_along_axis(v.T, order, 1)  # each dimension's list, ascending
    norm = float(np.sqrt((v.astype(float) ** 2).sum(1).max(initial=0))) * (1 + 1e-9)
    for i in range(len(q)):
        dims = np.flatnonzero(q[i])
        up = q[i, dims] > 0
        weight = np.abs(q[i, dims]).astype(float)
        unseen = np.ones(n, bool)
        unseen[np.searchsorted(ids, query_ids[i]) : np.searchsorted(ids, query_ids[i], "right")] = False
        rows, scores, depth, scored, beat = np.zeros(0, np.int64), np.zeros(0, v.dtype), min(first_depth, n), 0, least[i]
        read = np.zeros(len(dims), np.int64)  # how far each list has been read
        heaviest = np.argsort(-weight, kind="stable")
        left = np.sqrt(np.append(np.cumsum(weight[heaviest][::-1] ** 2)[::-1], 0.0)) * norm
        while True:
            # Lists of small weight stay unread while the norm bounds what they add to half of the score to beat.
            lists = heaviest[: max(1, int((left > max(beat, 0.0) / 2).sum()))]
            met = np.full(n, depth == n or not len(dims))
            for j in lists if depth < n else ():
                met[order[dims[j], n - depth : n - read[j]] if up[j] else order[dims[j], read[j] : depth]] = True
            read[lists] = depth
            new = np.flatnonzero(met & unseen)
            unseen[new] = False
            scored += len(new)
            found = v[new] @ q[i] if len(new) < n // 2 else (v @ q[i])[new]
            good = found >= least[i]
            rows, scores = _best(np.concatenate([scores, found[good]]), np.concatenate([rows, new[good]]), k)
            beat = max(least[i], float(scores[-1]) if len(rows) == k else -np.inf)
            if depth == n or not len(dims):
                break
            at = np.maximum(read, 1)
            most = np.where(up, ranked[dims, n - at], -ranked[dims, at - 1]).astype(float)
            if beat > -np.inf and _bound(weight, most, norm) * (1 + 1e-9) + 1e-6 < beat:
                break
            depth = min(depth * READ, n)
        yield i, rows, scores, scored


def _search(candidates: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each task; candidates and queries have a task `gid`, queries `least`."""

    def settle(t: pa.Table):
        side = t["side"].to_numpy()
        q, c = t.slice(0, int((side == 0).sum())), t.slice(int((side == 0).sum()))
        if not q.num_rows or not c.num_rows:
            return
        ids, query_ids = c["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        least = q["least"].to_numpy(zero_copy_only=False).astype(float) if q["least"].null_count == 0 else np.array([-np.inf if x is None else float(x) for x in q["least"].to_pylist()])
        found = list(threshold_top_k(ids, _matrix(c["v"], width), query_ids, _matrix(q["v"], width), k, least))
        n = [len(f[1]) for f in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(query_ids, n)), pa.array(ids[np.concatenate([f[1] for f in found])]), pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))], ["query_id", "vec_id", "score"]
        )

    def run(batches):
        for t in runs(batches, "gid"):  # sorted by gid, side, vec_id
            bounds = bounds_of(t["gid"].to_numpy())
            for s, e in zip(bounds[:-1], bounds[1:]):
                yield from settle(t.slice(s, e - s))

    rows = candidates.select("gid", F.lit(1).alias("side"), "vec_id", "v", F.lit(None).cast("bigint").alias("least"))
    rows = rows.union(queries.select("gid", F.lit(0).alias("side"), "vec_id", "v", "least"))
    return rows.repartition("gid").sortWithinPartitions("gid", "side", "vec_id").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _ranked(best: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query, k: int = 20, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """vectors (vec_id, v) -> query_id, rank, vec_id, score; is_query: a column over vectors."""
    store = Store(vectors.sparkSession)
    total = vectors.agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("asked"), F.max(F.size("v")).alias("width")).first()
    width = max(total["width"] or 1, 1)
    blocks, groups = max(1, -(-total["n"] // block)), max(1, -(-(total["asked"] or 0) // group))
    first_groups = max(groups, -(-(total["asked"] or 0) // 1024))  # the first block is searched by smaller groups, to use more tasks
    dealt = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(n)).cast("int")
    rows = vectors.withColumn("block", dealt("vec_id", blocks, 1))
    asked = vectors.where(is_query).dropDuplicates(["vec_id", "v"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    first = rows.where("block = 0").withColumn("gid", every(first_groups))
    best = store.keep(_ranked(_search(first, asked.select("vec_id", "v", dealt("vec_id", first_groups, 2).alias("gid"), F.lit(None).cast("bigint").alias("least")), width, k), k))
    if blocks > 1:
        reached = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        gid = lambda b, g: (b * groups + g).cast("int")
        queries = asked.join(reached, "vec_id", "left").withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1)))).withColumn("gid", gid(F.col("block"), dealt("vec_id", groups, 2)))
        others = rows.where("block > 0").withColumn("g", every(groups)).withColumn("gid", gid(F.col("block"), F.col("g")))
        best = best.select("query_id", "vec_id", "score").union(_search(others, queries, width, k))
        best = _ranked(best, k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
