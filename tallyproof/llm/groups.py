"""Rows that meet by a key: whole runs of a sorted stream, and hot keys dealt to blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts over which the rows of a hot key are spread before its number of blocks is joined.
SALTS = 64


def runs(batches: Iterable[pa.RecordBatch], key: str, size: int = 1 << 21) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from a stream sorted by `key`: as many runs as make `size` bytes."""
    held: list[pa.Table] = []
    done, last, weight = 0, None, 0  # the first `done` tables held are whole runs
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = t[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if last is not None and k[0] != last:
            done = len(held)
        for s, e in zip([0, *cuts[-1:]], [*cuts[-1:], len(k)]):
            if s or not len(cuts):  # the batch's last run, which may go on
                done = len(held) if s else done
            part = t.slice(s, e - s)
            held.append(part)
            weight += part.nbytes
        last = k[-1]
        if weight >= size and done:
            yield pa.concat_tables(held[:done])
            held = held[done:]
            done, weight = 0, sum(h.nbytes for h in held)
    if held:
        yield pa.concat_tables(held)


def bounds_of(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys start, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def with_blocks(rows: DataFrame, key: str, node: str, weight, most: int) -> DataFrame:
    """rows with `blocks`: into how many blocks of total weight `most` the rows of their key are dealt.

    Only keys of more than one block enter the joined table, once for each salt, so it never
    has more rows than `rows`, and no task holds all rows of a hot key.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks")).where("blocks > 1")
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(node, F.lit(3)), F.lit(SALTS)).cast("int")).join(spread, [key, "salt"], "left")
    return dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("salt")
