"""Exact k-means over integer vectors, with distances screened by the norms of segments.

A vector is compressed to the norms of its segments of some SEGMENT components, computed once
and written beside it; so are centroids. By Cauchy-Schwarz the squared distance is at least the
sum over segments of the squared difference of norms. A vector gets its exact integer distance
to the centroid with the least bound, then only to those whose bound doesn't exceed the best
distance so far; a bound is lowered by its rounding error first, so ties are never screened out.

A round is one pass over the written vectors: each task assigns its own and adds them up
(k sums), so no cluster is gathered, however large; centroids are k rows on the driver and go
to every task. Means are floor(sum / count) in exact integers. Rounds end early when no
centroid moves, as later ones change nothing.

Vectors that are null, of another length, or with null or non-finite components take no part.
Components are longs, as floor() gives them (beyond 2**63 they saturate); a distance or an
inertia that exceeds a long is null. Rows count one by one, whatever ids repeat or are null
(null hashes as the empty text); starting rows with equal hashes are ordered by their vectors.
With fewer rows than k there are as many centroids as rows; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store

SEGMENT = 8
#: Components below this in size give distances of less than 2**63 in 64 bits (up to 512 components).
SMALL = 1 << 26
LONG = (1 << 63) - 1
_SUM = pa.decimal128(38, 0)


def integer_vectors(table: DataFrame, dims: int = 64, scale: int = 1024, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v array<bigint> of the rows that take part."""
    ok = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.where(F.coalesce(ok, F.lit(False))).select(F.col(id).cast("bigint").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, in 64 bits where squared distances fit them, else as Python's."""
    x = column.flatten().to_numpy().reshape(-1, dims)
    return x if x.dtype.kind == "f" or not x.size or max(int(x.max()), -int(x.min())) < SMALL else x.astype(object)


def segment_norms(x: np.ndarray) -> np.ndarray:
    squares = x.astype(float) ** 2
    cuts = np.arange(0, x.shape[1], SEGMENT)
    return np.sqrt(np.add.reduceat(squares, cuts, axis=1)) if x.shape[1] else np.zeros((len(x), 0))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and exact squared distance of each row, and how many distances were computed."""
    if len(x) and (x.dtype == object or max(map(abs, centroids.ravel().tolist()), default=0) >= SMALL):
        x, centroids = x.astype(object), centroids.astype(object)
    else:
        centroids = centroids.astype(np.int64)
    of = segment_norms(centroids)
    size = (norms**2).sum(1)[:, None] + (of**2).sum(1)[None, :]
    bound = size - 2 * norms @ of.T - 1e-12 * size
    first = bound.argmin(1)
    cluster = first.copy()
    best = ((x - centroids[cluster]) ** 2).sum(1)
    done = len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero((first != c) & (bound[:, c] <= best.astype(float) * (1 + 1e-12)))
        d = ((x[rows] - centroids[c]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = d[better], c
        done += len(rows)
    return cluster, best, done


def compressed(vectors: DataFrame, dims: int) -> DataFrame:
    """vectors with the norms of their segments."""

    def run(batches):
        for b in batches:
            norms = segment_norms(_matrix(b.column(1), dims))
            offs = pa.array(np.arange(len(norms) + 1, dtype=np.int32) * norms.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offs, pa.array(norms.ravel()))], ["vec_id", "v", "norms"])

    return vectors.mapInArrow(run, "vec_id bigint, v array<bigint>, norms array<double>")


def start(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids, after the seed, have the smallest SHA-256."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r["v"] for r in vectors.select("v", h.alias("h")).orderBy("h", "v").limit(k).collect()]


def _batches(batches, dims: int, centroids: list[list[int]]):
    c = np.array(centroids, object)
    for b in batches:
        x = _matrix(b.column(1), dims)
        yield b, x, *nearest(x, b.column(2).flatten().to_numpy().reshape(len(x), -1), c)


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; vectors: vec_id, v, norms."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches):
        sums, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for _, x, cluster, _, _ in _batches(batches, dims, centroids):
            for c in np.unique(cluster):
                rows = x[cluster == c]
                sums[c] += rows.sum(0).astype(object)
                counts[c] += len(rows)
        full = np.flatnonzero(counts)
        rows = len(full) * dims
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(full))), pa.array([Decimal(int(s)) for s in sums[full].ravel()], _SUM), pa.array(np.repeat(counts[full], dims) if rows else np.zeros(0, np.int64))], ["cluster", "dim", "total", "n"])

    parts = vectors.mapInArrow(run, "cluster int, dim int, total decimal(38,0), n bigint")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k times the components
        out[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, and how many exact distances each took (`computed`, per batch, in its first row)."""
    dims = len(centroids[0])

    def run(batches):
        for b, x, cluster, best, done in _batches(batches, dims, centroids):
            far = [int(d) if d <= LONG else None for d in best.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(far, pa.int64()), pa.array([done] * bool(len(x)) + [0] * (len(x) - 1), pa.int64())], ["vec_id", "cluster", "distance", "computed"])

    return vectors.mapInArrow(run, "vec_id bigint, cluster int, distance bigint, computed bigint")


def centroid_text(centroid: list[int]) -> str:
    return ",".join(map(str, centroid))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """vectors (vec_id, v of one length) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid array<bigint>."""
    store = Store(vectors.sparkSession)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    centroids = start(vectors, k, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    table = store.keep(compressed(vectors, len(centroids[0])))
    for _ in range(rounds):
        last, centroids = centroids, moved(table, centroids)
        if centroids == last:
            break
    rows = store.keep(assigned(table, centroids)).drop("computed")
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(total.alias("d")).collect()}  # at most k rows
    long = lambda d: int(d) if d is not None and d <= LONG else None
    everything = None if None in sums.values() else long(sum(sums.values()))
    found = [(c, long(sums[c]), everything, centroids[c]) for c in sorted(sums)]
    per = vectors.sparkSession.createDataFrame(found, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
