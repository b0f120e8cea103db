"""Removal of every byte that lies in a 100-byte string which also starts earlier.

The suffixes of a whole corpus don't fit one sort, so hashes first bring suffixes that can
be equal together; a suffix sort then decides which are, and only it removes anything.

1. Chunks. Texts are cut where a hash of 8 bytes is the least of 2 * REACH + 1 neighbouring
   ones, about every 260 bytes and in equal text at equal places. A chunk is the windows that
   start in it. Chunks whose bytes hash alike meet and are sorted as suffixes; of equal ones
   all but the earliest are removed. That clears copied documents and passages with little
   more text moved than they have.
2. Anchors, for the windows left. Within a 100-byte window the 32-byte gram with the least
   hash is its anchor (ties: the first), so equal windows have equal anchors at equal places.
   Neighbouring windows mostly share theirs: about one anchor in 35 bytes, each with the run
   of windows that it serves. One row leaves for each run: gram, document, place.
3. By gram. Rows are sorted by gram; one whose gram no other row has is finished, all others
   go on. Beyond HOT runs of one gram in a batch they go on at once, and one mark of the gram
   meets the rows elsewhere, so a gram in a third of all documents is gathered nowhere.
4. The text of these runs is fetched and cut in two: windows that start near the gram hold
   the 66 bytes from the gram on, the others the 67 bytes that end with it. These bytes are
   the key they meet by, so windows that can't be equal rarely meet.
5. Under each key equal pieces are sorted out first; of the others, the suffixes at one
   distance from the gram are sorted window by window. In each class of equal ones all but
   the earliest are removed.
6. The removed intervals join the texts by document. Steps 1, 2, 4 and 6 read one and the
   same exchange of the texts.

Every sort is a bottom-up mergesort. Two suffixes are compared by their longest common
extension, found by binary search over prefix polynomial hashes (7 steps for 100 bytes),
then by one byte. Neighbours that agree by hash are verified byte by byte. Equal chunks,
runs and pieces of one batch of texts are sorted out before anything is sent, and those of a
large key as its rows come in, so a passage in a third of all documents is held nowhere.

Order: smaller doc_id, or same document and earlier start. Null text is empty; a null doc_id
counts as the smallest id; texts under 100 bytes lose nothing. Rows that share a doc_id but
not the text are documents of their own, in the order of a hash of their texts; repeated
rows (equal id and text) have equal starts, so neither is earlier than the other. Other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import bounds_of
from .words import PrefixHashes, byte_hashes, lanes, mix64, text_blocks

LENGTH = 100
GRAM = 32
#: A cut between chunks has the least hash of so many places to either side.
REACH = 128
#: Windows of the longest chunk.
MOST = 4096
#: Differing runs of one gram in a batch beyond which they aren't gathered by gram.
HOT = 32
#: Bytes of text that a task handles together.
BATCH = 1 << 23
#: Bytes of runs that are sorted together in a task.
SORTED = 1 << 22
_PIECE = 1 << 17
_LEAST = -(1 << 63)
_U = np.uint64


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), then first[1], ..."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on."""
    n, view = len(data) - size + 1, lanes(data)
    mixed = mix64(view, 1)
    out = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k, at in enumerate([*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]):
            out += mixed[at : at + n] * (mix64(np.array([k], _U), 15)[0] | _U(1))
    return mix64(out, 2)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring keys."""
    padded = np.concatenate([key, np.full(-len(key) % width + width, ~_U(0), _U)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - width + 1
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


_PLACE = _U((1 << 24) - 1)


def _placed(hashes: np.ndarray) -> np.ndarray:
    """Keys that order by hash, then place."""
    return (hashes & ~_PLACE) | np.arange(len(hashes)).astype(_U)


def _inside(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.clip(lo, 0, n), 1)
    np.add.at(step, np.clip(hi, 0, n), -1)
    return np.cumsum(step[:-1]) > 0


def _chunks(data: np.ndarray, offsets: np.ndarray, length: int, reach: int = REACH, most: int = MOST):
    """Of a block: (first window, number of windows) of all chunks."""
    cuts, width = [], 2 * reach + 1
    for x in range(0, max(len(data) - width + 1, 0), _PIECE):
        view = lanes(data[x : x + _PIECE + width + 6])[:-7]
        if len(view) < width:
            break
        with np.errstate(over="ignore"):
            least = _least(_placed(view * _U(0x9E3779B97F4A7C15)), width) & _PLACE
        cuts.append(x + reach + np.flatnonzero(least == np.arange(len(least)).astype(_U) + _U(reach)))
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    start = np.unique(np.concatenate([offsets[:-1][windows > 0], *cuts]))
    of = np.searchsorted(offsets, start, "right") - 1
    start, of = (v[start < offsets[of] + windows[of]] for v in (start, of))
    stop = np.minimum(np.append(start[1:], len(data)), offsets[of] + windows[of])
    parts = -(-(stop - start) // most)
    first = np.repeat(start, parts) + most * _spread(np.zeros(len(parts), np.int64), parts)
    return first, np.minimum(np.repeat(stop, parts) - first, most)


def _anchors(data: np.ndarray, offsets: np.ndarray, gone: tuple[np.ndarray, np.ndarray], length: int, gram: int):
    """Of a block: (first window, number of windows, anchor, gram hash, hash of the run), windows by their starts; those in `gone` (from, to) are left out."""
    parts = []
    last = np.maximum(offsets[1:] - length + 1, offsets[:-1])  # windows of a document start before this
    live = _inside(offsets[:-1], last, len(data)) & ~_inside(*gone, len(data))
    for x in range(0, max(len(data) - length + 1, 0), _PIECE):
        ok = live[x : x + _PIECE]
        part = data[x : x + _PIECE + length - 1]
        ok = ok[: len(part) - length + 1]
        if not ok.any():
            continue
        grams = _grams(part, gram)
        anchor = (_least(_placed(grams), length - gram + 1) & _PLACE).astype(np.int64)
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
        starts = np.flatnonzero(new)
        stops = np.flatnonzero(ok & np.concatenate([~ok[1:] | (anchor[1:] != anchor[:-1]), [True]])) + 1
        a = anchor[starts]
        run, size = grams[stops + length - 1 - gram].copy(), stops - starts + length - 1
        with np.errstate(over="ignore"):
            for k in range(0, int(size.max()) // gram):
                i = np.flatnonzero(size >= (k + 1) * gram)
                run[i] += mix64(grams[starts[i] + k * gram], 60 + k)
        parts.append((starts + x, stops - starts, a + x, grams[a], run))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _less(data, prefix, a, b, most, or_equal):
    n = prefix.common_extension(a, b, most)
    end = n == most
    i = np.where(end, 0, n)
    return np.where(end, or_equal, data[a + i] < data[b + i])


def suffix_sort(data: np.ndarray, prefix: PrefixHashes, at: np.ndarray, segment: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Order of the suffixes `at`, by their first `most` bytes within each (non-decreasing) segment.

    A bottom-up mergesort, all segments' merges of a level at once: an element's place in
    the merged run is its own rank plus its rank in the sibling run, by binary search.
    `most` may differ between segments.
    """
    n = len(at)
    order = np.arange(n)
    if not n:
        return order
    most = np.broadcast_to(np.asarray(most, np.int64), n)
    bounds = bounds_of(segment)
    sizes = np.diff(bounds)
    start, size = np.repeat(bounds[:-1], sizes), np.repeat(sizes, sizes)
    length = 1
    active = np.flatnonzero(size > 1)
    while len(active):
        base, total = start[active], size[active]
        i = active - base
        mine = (i // length) * length
        odd = (i // length) % 2 == 1
        lo = np.where(odd, mine - length, mine + length)
        hi = np.minimum(lo + length, total)
        place = np.where(odd, lo, mine)  # where the merged run starts
        own = i - mine
        first, lo, hi = lo, lo.copy(), np.maximum(hi, lo)
        element = at[order[active]]
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            other = at[order[base[todo] + mid]]
            up = _less(data, prefix, other, element[todo], most[active[todo]], odd[todo])
            lo[todo] = np.where(up, mid + 1, lo[todo])
            hi[todo] = np.where(up, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        target = base + place + own + (lo - first)
        new = order.copy()
        new[target] = order[active]
        order = new
        length *= 2
        active = active[total > length]
    return order


def _classes(data: np.ndarray, prefix: PrefixHashes, at: np.ndarray, segment: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class of each ordered suffix): equal classes have equal segments and equal `most` bytes, verified."""
    order = suffix_sort(data, prefix, at, segment, most)
    at, most = at[order], most[order]
    same = (segment[1:] == segment[:-1]) if len(at) else np.zeros(0, bool)
    i = np.flatnonzero(same)
    same[i] = prefix.common_extension(at[i], at[i + 1], most[i]) == most[i]
    i = np.flatnonzero(same)
    for x in range(0, len(i), 1 << 14):  # by bytes, against colliding hashes
        j = i[x : x + (1 << 14)]
        differ = data[_spread(at[j], most[j])] != data[_spread(at[j + 1], most[j])]
        first = np.cumsum(most[j]) - most[j]
        same[j] &= ~np.logical_or.reduceat(differ, first)
    return order, np.cumsum(np.concatenate([[True], ~same])[: len(at)]) - 1


def _later(cls: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of the first of each class by place, indexes of those at a later place); repeated places are neither."""
    if not len(cls):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((*reversed(place), cls))
    bounds = bounds_of(cls[order])
    first = np.repeat(order[bounds[:-1]], np.diff(bounds))
    later = np.zeros(len(order), bool)
    for p in place:
        later |= p[order] != p[first]
    return order[bounds[:-1]], order[later]


def _sort_out(data: np.ndarray, group: np.ndarray, shape: np.ndarray, at: np.ndarray, size: np.ndarray, *place: np.ndarray):
    """Strings (group, shape; `size` bytes from `at` on): indexes of the earliest of equal ones, and of later ones.

    Only strings that share group and shape are sorted, some SORTED bytes of them at once.
    """
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((shape, group))
    g, s = group[order], shape[order]
    segment = np.cumsum(np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])) - 1
    alone = np.bincount(segment)[segment] == 1
    rest, segment = order[~alone], segment[~alone]
    first, later = [order[alone]], [np.zeros(0, np.int64)]
    total, done = np.cumsum(size[rest]), 0
    while done < len(rest):
        to = int(np.searchsorted(total, total[done] + SORTED))
        to = int(np.searchsorted(segment, segment[min(to, len(rest)) - 1], "right"))  # whole segments
        i = rest[done:to]
        part = data[_spread(at[i], size[i])]
        o, cls = _classes(part, PrefixHashes(part), np.cumsum(size[i]) - size[i], segment[done:to], size[i])
        f, n = _later(cls, *(p[i[o]] for p in place))
        first.append(i[o][f])
        later.append(i[o][n])
        done = to
    return np.concatenate(first), np.concatenate(later)


def _merge(doc, tie, start, stop):
    """Sorted, with touching intervals of a document merged."""
    o = np.lexsort((start, tie, doc))
    doc, tie, start, stop = doc[o], tie[o], start[o], stop[o]
    if not len(o):
        return doc, tie, start, stop
    # Furthest stop so far within the document, by one running maximum over doc-ordered keys.
    other = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    group = np.cumsum(np.concatenate([[True], other])) - 1
    span = int(stop.max()) + 1
    far = np.maximum.accumulate(group * span + stop) - group * span
    head = np.concatenate([[True], other | (start[1:] > far[:-1])])
    last = np.concatenate([np.flatnonzero(head)[1:] - 1, [len(o) - 1]])
    return doc[head], tie[head], start[head], far[last]


def _batches(columns: dict[str, np.ndarray], rows: int = 100_000):
    n = len(next(iter(columns.values())))
    for i in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(v[i : i + rows]) for v in columns.values()], list(columns))


def _text_batches(batches, text: str):
    """(record batch, its rows a to e, bytes, offsets), gathered to some BATCH bytes of whole texts."""
    held, size = [], 0
    for b in batches:
        for a, e, data, offs in text_blocks(b.column(b.schema.get_field_index(text)), BATCH):
            if held and size + len(data) > BATCH:
                yield held
                held, size = [], 0
            held.append((b.slice(a, e - a), data, offs))
            size += len(data)
    if held:
        yield held


def _together(held):
    """The parts of a batch as one: bytes, offsets, and a table of the other columns."""
    shift = np.cumsum([0, *(len(d) for _, d, _ in held)])
    data = held[0][1] if len(held) == 1 else np.concatenate([d for _, d, _ in held])
    offs = np.concatenate([[0], *(o[1:] + x for (_, _, o), x in zip(held, shift))])
    return data, offs, pa.Table.from_batches([b for b, _, _ in held])


def _ids(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(t[c].to_numpy().astype(np.int64) for c in ("doc", "tie"))


#: Kinds of rows: one that goes on if another has its key, one that goes on, the mark of a hot gram, a removed one.
_PLAIN, _OPEN, _MARK, _GONE = range(4)
#: key: what a row is dealt by; size: windows, and 256 times the anchor's distance for runs.
_ROW = "key bigint, kind int, doc bigint, tie bigint, lo int, size int"


def _rows(kind: int, key, doc, tie, lo, size):
    yield from _batches({"key": key, "kind": np.full(len(key), kind, np.int32), "doc": doc, "tie": tie, "lo": lo.astype(np.int32), "size": size.astype(np.int32)})


def _spread_key(doc, tie, lo) -> np.ndarray:
    """A key by document and place, for rows that need meet no others."""
    return mix64(mix64(doc.view(_U), 8) ^ tie.view(_U) ^ lo.astype(np.int64).view(_U), 8).view(np.int64)


def _gone(doc, tie, lo, count):
    """Rows of removed windows, merged within a batch."""
    d, t, start, stop = _merge(doc, tie, lo, lo + count)
    yield from _rows(_GONE, _spread_key(d, t, start), d, t, start, stop - start)


def _string_keys(data, at, size) -> np.ndarray:
    """A hash of each string."""
    view = memoryview(data)
    return np.array([int.from_bytes(hashlib.blake2b(view[a:e], digest_size=8).digest(), "little", signed=True) for a, e in zip(at.tolist(), (at + size).tolist())], np.int64)


def _chunk_rows(batches, length: int):
    """Step 1: all chunks of texts (doc_id, doc, tie, text)."""
    for held in _text_batches(batches, "text"):
        data, offs, t = _together(held)
        doc, tie = _ids(t)
        at, count = _chunks(data, offs, length)
        of = np.searchsorted(offs, at, "right") - 1
        d, ti, lo, size = doc[of], tie[of], at - offs[of], count + length - 1
        key = _string_keys(data, at, size)
        first, later = _sort_out(data, key, count, at, size, d, ti, lo)
        yield from _gone(d[later], ti[later], lo[later], count[later])
        yield from _rows(_PLAIN, key[first], d[first], ti[first], lo[first], count[first])


def _run_rows(batches, length: int, gram: int, most: int):
    """Step 2: the runs of windows of texts (doc_id, doc, tie, text, gone)."""
    for held in _text_batches(batches, "text"):
        data, offs, t = _together(held)
        doc, tie = _ids(t)
        row, lo, count = _listed(t["gone"])
        at, count, anchor, g, run = _anchors(data, offs, (offs[row] + lo, offs[row] + lo + count), length, gram)
        of = np.searchsorted(offs, at, "right") - 1
        d, ti, lo, shape, g = doc[of], tie[of], at - offs[of], (anchor - at) * 256 + count, g.view(np.int64)
        first, later = _sort_out(data, run, shape, at, count + length - 1, d, ti, lo)  # runs that hash alike
        yield from _gone(d[later], ti[later], lo[later], count[later])
        first = first[np.argsort(g[first], kind="stable")]
        bounds = bounds_of(g[first]) if len(first) else np.zeros(1, np.int64)
        hot = np.repeat(np.diff(bounds) > most, np.diff(bounds))
        for kind, i in ((_PLAIN, first[~hot]), (_OPEN, first[hot])):
            yield from _rows(kind, g[i] if kind == _PLAIN else _spread_key(d[i], ti[i], lo[i]), d[i], ti[i], lo[i], shape[i])
        m = np.unique(g[first[hot]])
        yield from _rows(_MARK, m, *(np.zeros(len(m), np.int64) for _ in range(4)))


def _listed(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, size) of a column of lists of structs."""
    lists = column.combine_chunks()
    row = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    each = lists.flatten()
    return row, *(each.field(i).to_numpy().astype(np.int64) for i in (0, 1))


def _shared(batches):
    """Of rows sorted by key: plain rows whose key no other row has are left out, marks too."""

    def settle(c, more):
        key, kind = c["key"], c["kind"]
        meets = np.flatnonzero((kind == _PLAIN) | (kind == _MARK))
        same = c["tied"].copy()
        equal = key[meets[1:]] == key[meets[:-1]]
        same[meets[1:]] |= equal
        same[meets[:-1]] |= equal
        keep = (kind == _GONE) | (kind == _OPEN) | ((kind == _PLAIN) & same)
        last = None
        if more and len(meets):  # the last of them waits for the next batch
            tail = meets[-1]
            keep[tail] = False
            last = {k: v[tail : tail + 1] for k, v in c.items()} | {"tied": same[tail : tail + 1]}
        return {k: v[keep] for k, v in c.items() if k != "tied"}, last

    last = None
    for b in batches:
        c = {f.name: b.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(b.schema)} | {"tied": np.zeros(b.num_rows, bool)}
        if last is not None:
            c = {k: np.concatenate([last[k], v]) for k, v in c.items()}
        out, last = settle(c, True)
        yield from _batches(out)
    if last is not None:
        yield from _batches(settle(last, False)[0])


#: Strings to be sorted, with their bytes, and removed windows (from lo on, size of them) without.
_PIECE_ROW = "key bigint, doc bigint, tie bigint, lo int, size int, piece binary"


def _piece_rows(key, doc, tie, lo, size, data=None, at=None, bytes_=None, most: int = 20_000):
    for x in range(0, len(key), most):
        k = slice(x, x + most)
        n = len(key[k])
        piece = pa.nulls(n, pa.binary())
        if data is not None:
            ends = np.cumsum(bytes_[k])
            piece = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[_spread(at[k], bytes_[k])])])
        yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(doc[k]), pa.array(tie[k]), pa.array(lo[k].astype(np.int32)), pa.array(size[k].astype(np.int32)), piece], ["key", "doc", "tie", "lo", "size", "piece"])


def _gone_pieces(doc, tie, lo, count):
    d, t, start, stop = _merge(doc, tie, lo, lo + count)
    yield from _piece_rows(_spread_key(d, t, start), d, t, start, stop - start)


def _fetch_chunks(batches, length: int):
    """The text of chunks (doc_id, doc, tie, text, live, gone)."""
    for held in _text_batches(batches, "text"):
        data, offs, t = _together(held)
        doc, tie = _ids(t)
        row, lo, count = _listed(t["gone"])
        yield from _gone_pieces(doc[row], tie[row], lo, count)
        row, lo, count = _listed(t["live"])
        at, size, d, ti = offs[row] + lo, count + length - 1, doc[row], tie[row]
        key = _string_keys(data, at, size)
        first, later = _sort_out(data, key, count, at, size, d, ti, lo)
        yield from _gone_pieces(d[later], ti[later], lo[later], count[later])
        i = np.sort(first)
        yield from _piece_rows(key[i], d[i], ti[i], lo[i], count[i], data, at[i], size[i], 4_000)


def _pieces(lo, shape, length: int, gram: int):
    """The two pieces of each run: (which run, lo, shape, first and end of the bytes they meet by, from the text's start)."""
    count, back = shape & 255, shape >> 8
    half = (length - gram) // 2
    out = []
    # A window at distance o before the gram: o = back, back - 1, ... Far windows (o > half) come first.
    far = np.clip(back - half, 0, count)
    for side, skip, n in ((0, np.zeros_like(far), far), (1, far, count - far)):
        at = np.flatnonzero(n > 0)
        anchor = lo[at] + back[at]
        meets = (anchor - half - 1, anchor + gram) if side == 0 else (anchor, anchor + length - half)
        out.append((at, lo[at] + skip[at], ((back[at] - skip[at]) << 8) + n[at], *meets, np.full(len(at), side)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _fetch_runs(batches, length: int, gram: int):
    """Step 4: the pieces of runs, from texts (doc_id, doc, tie, text, live, gone)."""
    for held in _text_batches(batches, "text"):
        data, offs, t = _together(held)
        doc, tie = _ids(t)
        row, lo, count = _listed(t["gone"])
        yield from _gone_pieces(doc[row], tie[row], lo, count)
        row, lo, shape = _listed(t["live"])
        which, lo, shape, x, y, side = _pieces(lo, shape, length, gram)
        row = row[which]
        base, d, ti, size = offs[row], doc[row], tie[row], (shape & 255) + length - 1
        key = mix64(byte_hashes(data, base + x, base + y, 9) ^ side.astype(_U), 10).view(np.int64)
        first, later = _sort_out(data, key, shape, base + lo, size, d, ti, lo)
        yield from _gone_pieces(d[later], ti[later], lo[later], shape[later] & 255)
        i = np.sort(first)
        yield from _piece_rows(key[i], d[i], ti[i], lo[i], shape[i], data, base[i] + lo[i], size[i])


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and offsets."""
    pieces = column.combine_chunks()
    _, offs, raw = pieces.buffers()
    offs = np.frombuffer(offs, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    return np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def _equal_strings(t: pa.Table, mask: int):
    """(indexes of the earliest of equal strings, removed windows of the later ones) under whole keys or a part of one."""
    doc, tie = _ids(t)
    lo, shape = t["lo"].to_numpy().astype(np.int64), t["size"].to_numpy().astype(np.int64)
    data, offs = _bytes_of(t["piece"])
    first, later = _sort_out(data, t["key"].to_numpy(), shape, offs[:-1], np.diff(offs), doc, tie, lo)
    return np.sort(first), (doc[later], tie[later], lo[later], shape[later] & mask)


def _equal_windows(t: pa.Table, length: int):
    """Step 5, of different pieces under whole keys: windows removed."""
    key = t["key"].to_numpy()
    group = np.unique(key, return_inverse=True)[1]
    t = t.filter(pa.array(np.bincount(group)[group] > 1))
    if not t.num_rows:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    doc, tie = _ids(t)
    key, lo, shape = t["key"].to_numpy(), t["lo"].to_numpy().astype(np.int64), t["size"].to_numpy().astype(np.int64)
    data, offs = _bytes_of(t["piece"])
    count, back = shape & 255, shape >> 8
    run, k = np.repeat(np.arange(len(key)), count), _spread(np.zeros(len(key), np.int64), count)
    # Segments: the key, and how far before the gram the window starts.
    by = np.unique(key, return_inverse=True)[1][run] * 256 + (back[run] - k)
    o = np.argsort(by, kind="stable")
    run, k, by = run[o], k[o], by[o]
    s, cls = _classes(data, PrefixHashes(data), offs[run] + k, by, np.full(len(run), length, np.int64))
    run, k = run[s], k[s]
    d, ti, p = doc[run], tie[run], lo[run] + k
    _, late = _later(cls, d, ti, p)
    return d[late], ti[late], p[late], np.ones(len(late), np.int64)


_REMOVED = "doc bigint, tie bigint, lo bigint, size bigint"


def _settle(batches, length: int, windows: bool, limit: int = 1 << 22):
    """Removed windows among strings sorted by key, document and place, which come as rows of _PIECE_ROW.

    Some `limit` bytes are handled at once. Of a key that is larger, the earliest of the equal
    strings so far are kept and the later ones leave before more are read.
    """

    def merged(*parts):
        doc, tie, lo, count = (np.concatenate(c) for c in zip(*parts))
        d, t, start, stop = _merge(doc, tie, lo, lo + count)
        yield from _batches({"doc": d, "tie": t, "lo": start, "size": stop - start})

    held, size, most = [], 0, limit
    for b in batches:
        whole = pa.Table.from_batches([b])
        known = whole.filter(whole["piece"].is_null())
        if known.num_rows:
            yield from merged((*_ids(known), *(known[c].to_numpy().astype(np.int64) for c in ("lo", "size"))))
        t = whole.filter(whole["piece"].is_valid())
        if not t.num_rows:
            continue
        held.append(t)
        size += t.nbytes
        if size >= most:
            t = pa.concat_tables(held)
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            ready, rest = t.slice(0, cut), t.slice(cut)  # all keys but the last are whole
            if cut:
                yield from merged(*_found(ready, length, windows))
            if rest.nbytes >= limit:
                first, gone = _equal_strings(rest, 255 if windows else -1)
                yield from merged(gone)
                rest = rest.take(pa.array(first))
            held, size = [rest], rest.nbytes
            most = max(limit, 2 * size)
    if held:
        yield from merged(*_found(pa.concat_tables(held), length, windows))


def _found(t: pa.Table, length: int, windows: bool):
    first, gone = _equal_strings(t, 255 if windows else -1)
    return [gone, _equal_windows(t.take(pa.array(first)), length)] if windows else [gone]


def _meeting(rows: DataFrame) -> DataFrame:
    """Per document: the rows that go on, and the windows known as removed."""
    shared = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, _ROW)
    where = F.struct("lo", "size")
    return shared.groupBy("doc", "tie").agg(F.collect_list(F.when(F.col("kind") != _GONE, where)).alias("live"), F.collect_list(F.when(F.col("kind") == _GONE, where)).alias("gone"))


def _removed(strings: DataFrame, length: int, windows: bool) -> DataFrame:
    """Per document: the windows that a sort of the strings removes."""
    found = strings.repartition("key").sortWithinPartitions("key", "doc", "tie", "lo").mapInArrow(lambda b: _settle(b, length, windows), _REMOVED)
    return found.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "size")).alias("gone"))


def removed_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Two tables (doc, tie, gone): starts of removed windows, from the chunks and from the runs. docs: (doc_id, doc, tie, text)."""
    columns = ["doc_id", "doc", "tie", "text"]
    by = ["doc", "tie"]
    chunks = _meeting(docs.mapInArrow(lambda b: _chunk_rows(b, length), _ROW))
    texts = docs.join(chunks, by).select(*columns, "live", "gone").mapInArrow(lambda b: _fetch_chunks(b, length), _PIECE_ROW)
    in_chunks = _removed(texts, length, False)
    live = docs.join(in_chunks, by, "left").select(*columns, "gone")
    run_rows = _meeting(live.mapInArrow(lambda b: _run_rows(b, length, gram, most), _ROW))
    pieces = docs.join(run_rows, by).select(*columns, "live", "gone").mapInArrow(lambda b: _fetch_runs(b, length, gram), _PIECE_ROW)
    return in_chunks, _removed(pieces, length, True)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, kept (binary), spans array<struct<start: bigint, stop: bigint>> (removed, maximal)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows are told apart by a hash of the text; where every id is there once, that says nothing and 0 stands for it.
    # (Neither doc nor tie can be null, so no join adds a filter of its own and all read the same exchange.)
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(_LEAST))).select("doc_id", "doc", (F.xxhash64("text") if repeated else F.coalesce(F.pmod("doc", F.lit(1).cast("bigint")), F.lit(0).cast("bigint"))).alias("tie"), "text")
    in_chunks, in_runs = removed_windows(docs, length, gram, most)
    joined = docs.join(in_chunks.withColumnRenamed("gone", "first"), ["doc", "tie"], "left").join(in_runs, ["doc", "tie"], "left").select("doc_id", "doc", "tie", "text", "first", "gone")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for b in batches:
            size, kept, spans = [], [], []
            for a, e, data, offs in text_blocks(b.column(3)):
                of, lo, n = (np.concatenate(c) for c in zip(*(_listed(pa.chunked_array([b.column(k).slice(a, e - a)])) for k in (4, 5))))
                of, _, start, stop = _merge(of, np.zeros_like(of), lo, lo + n + length - 1)
                left = ~_inside(offs[of] + start, offs[of] + stop, len(data))
                bounds = np.searchsorted(of, np.arange(e - a + 1))
                for i in range(e - a):
                    s = slice(offs[i], offs[i + 1])
                    size.append(int(offs[i + 1] - offs[i]))
                    kept.append(data[s][left[s]].tobytes())
                    spans.append([{"start": x, "stop": y} for x, y in zip(start[bounds[i] : bounds[i + 1]].tolist(), stop[bounds[i] : bounds[i + 1]].tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)], ["doc_id", "n_bytes", "kept", "spans"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, kept binary, spans array<struct<start: bigint, stop: bigint>>")


def brute_force(texts: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The contract by a dictionary of all windows; for tests on small fixtures."""
    first: dict[bytes, tuple[int, int]] = {}
    out = {}
    for doc, t in sorted(texts):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if first.setdefault(t[s : s + length], (doc, s)) != (doc, s):
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[doc] = (len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out
