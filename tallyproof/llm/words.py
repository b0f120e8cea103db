"""Vectorised tokenising and hashing of whole Arrow text batches with numpy.

Texts are handled as the UTF-8 bytes that Arrow already holds, many documents at a
time, so the cost per byte is a few array operations and no Python object is made for
a word. Blocks of whole documents bound the memory; one very long document makes a
block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer document is a block of its own).
BLOCK_BYTES = 1 << 20
#: The word separators of the contracts: space and \t \n \v \f \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), applied to each element; one-to-one for a salt."""
    with np.errstate(over="ignore"):
        z = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z ^= z >> _U(30)
        z *= _U(0xBF58476D1CE4E5B9)
        z ^= z >> _U(27)
        z *= _U(0x94D049BB133111EB)
        z ^= z >> _U(31)
    return z


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,)).copy()


#: Longest span that is hashed lane by lane; a longer one is hashed by itself.
_LANES = 32


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0, view: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans: the length and each 8 bytes pass through mix64 in turn.

    No algebraic structure: which bytes collide depends on all of them. Spans of more than
    8 * _LANES bytes are hashed by BLAKE2b.
    """
    view = lanes(data) if view is None else view
    size = ends - starts
    out = mix64(size.astype(_U), 100 + salt)
    live = np.flatnonzero((size > 0) & (size <= 8 * _LANES))
    k = 0
    while len(live):
        left = np.minimum(size[live] - k, 8).astype(_U)
        x = view[starts[live] + k] & (~_U(0) >> (_U(64) - left * _U(8)))
        out[live] = mix64(out[live] ^ x, 200 + salt)
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > 8 * _LANES):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([salt])).digest(), "little")
    return out


class PrefixHashes:
    """Prefix polynomial hashes of a byte string, modulo the prime 2**31 - 1 in two bases.

    The hash of any span follows from two prefixes: H[end] - H[start] * B**length. Kept as
    two arrays of 32 bits. Spans of up to PIECE bytes can be asked for.
    """

    PRIME = _U((1 << 31) - 1)
    PIECE = 1 << 16
    _tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @classmethod
    def tables(cls):
        """Of both bases: a value for each byte, powers, and inverse powers."""
        if not cls._tables:
            p = int(cls.PRIME)
            for k in (0, 1):
                base = int(mix64(np.array([k], _U), 51)[0]) % (p - 2) + 2
                out = []
                for b in (base, pow(base, -1, p)):
                    powers = [1]
                    for _ in range(cls.PIECE):
                        powers.append(powers[-1] * b % p)
                    out.append(np.array(powers, _U))
                values = mix64(np.arange(256, dtype=_U), 7 + k) % _U(p - 1) + _U(1)
                cls._tables.append((values, *out))
        return cls._tables

    @classmethod
    def reduce(cls, x: np.ndarray) -> np.ndarray:
        """x modulo the prime."""
        for _ in range(2):
            x = (x & cls.PRIME) + (x >> _U(31))
        return np.where(x >= cls.PRIME, x - cls.PRIME, x)

    def __init__(self, data: np.ndarray):
        self.h = []
        for value, power, inverse in self.tables():
            h = np.zeros(len(data) + 1, np.uint32)
            for k in range(0, len(data), self.PIECE):  # a piece's temporaries stay small, however long the text
                v = value[data[k : k + self.PIECE]]
                v[0] += int(h[k]) * int(power[1]) % int(self.PRIME)
                v *= inverse[: len(v)]
                v = self.reduce(np.cumsum(self.reduce(v)))
                v *= power[: len(v)]
                h[k + 1 : k + 1 + len(v)] = self.reduce(v)
            self.h.append(h)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Both hashes of each span, as one number of 62 bits."""
        out = np.zeros(len(start), _U)
        for h, (_, power, _) in zip(self.h, self.tables()):
            x = self.reduce(h[start].astype(_U) * power[end - start])
            out = (out << _U(31)) + self.reduce(h[end] + (self.PRIME - x))
        return out

    def common_extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Longest common extension, up to `most`, of the suffixes at a and b: binary search over the hashes."""
        low, high = np.zeros(len(a), np.int64), np.broadcast_to(np.asarray(most, np.int64), len(a)).copy()
        # H[a + m] - H[b + m] = (H[a] - H[b]) * B**m where the first m bytes agree.
        apart = [self.reduce(h[a].astype(_U) + (self.PRIME - h[b].astype(_U))) for h in self.h]
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = open_.copy()
            for h, d, (_, power, _) in zip(self.h, apart, self.tables()):
                far = self.reduce(h[a + mid].astype(_U) + (self.PRIME - h[b + mid].astype(_U)))
                same &= far == self.reduce(d * power[mid])
            low = np.where(same, mid, low)
            high = np.where(same | ~open_, high, mid - 1)
        return low


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole documents: (first row, end row, bytes, offsets of each row). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offs, raw = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + block_bytes, "right")) - 1)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def token_spans(data: np.ndarray, offsets: np.ndarray, is_token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of token bytes within each document; is_token: 256 booleans."""
    tok = is_token[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a run never crosses from one document into the next
    prev = np.zeros(len(data), bool)
    prev[1:] = tok[:-1]
    starts = np.flatnonzero(tok & (~prev | edge[:-1]))
    nxt = np.zeros(len(data), bool)
    nxt[:-1] = tok[1:]
    ends = np.flatnonzero(tok & (~nxt | edge[1:])) + 1
    return starts, ends


def _table(skip: tuple[int, ...]) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(skip)] = False
    return t


#: Bytes of words in the contracts' sense, `[^\x20\x09-\x0D]+`.
WORD_BYTES = _table(SPACES)
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_token: np.ndarray = WORD_BYTES, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's words in order, and each document's range in them (n + 1 bounds).

    `data` should be lower-cased already where case doesn't matter.
    """
    starts, ends = token_spans(data, offsets, is_token)
    return byte_hashes(data, starts, ends, salt), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of `size` words, and their bounds. Fewer words: none (see short_hashes)."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    n = len(words) - size + 1
    if n <= 0 or not counts.any():
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, _U)
        for k in range(size):
            h += words[k : k + n] * (mix64(np.array([k], _U), 11)[0] | _U(1))
    h = mix64(h, size)
    keep = np.zeros(n + 1, np.int32)
    ok = counts > 0
    np.add.at(keep, bounds[:-1][ok], 1)
    np.add.at(keep, (bounds[:-1] + counts)[ok], -1)
    return h[np.cumsum(keep[:-1]) > 0], np.concatenate([[0], np.cumsum(counts)])


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of one whole sequence of words (for texts shorter than a shingle)."""
    with np.errstate(over="ignore"):
        m = mix64(np.arange(len(words), dtype=_U), 11) | _U(1)
        return mix64(np.array([(words * m).sum(dtype=_U)], _U), 1000 + len(words))[0]
