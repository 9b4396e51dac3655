"""Vectorised word and window hashing over Arrow string columns.

Everything works on the UTF-8 bytes of a bounded chunk of documents: a byte table says
which bytes belong to words. A word's hash takes its bytes eight at a time through a
bijective mixer (beyond LONG bytes, xxh3 takes the rest), and a window's hash joins those of
its words pair by pair, so neither is linear and no kind of text collides by its structure.
`seed` 0 and 1 give independent hashes of the bytes; what has to be certain compares both,
or the bytes (`same_bytes`). A document longer than CHUNK_BYTES is a chunk by itself, so
memory follows the longest text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
LONG = 64
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_JOIN = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space-separated words: everything but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Letters and digits of ASCII, and every byte above it.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: Runs of ALNUM bytes, and runs of punctuation.
TOKENS = np.where(ALNUM, 1, 2).astype(np.uint8)
TOKENS[[0x20, 9, 10, 11, 12, 13]] = 0


def trim() -> None:
    """Gives memory that this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of runs of bytes."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) * _JOIN[seed] ^ _SEEDS[seed])
    h ^= lanes[start] & _LANE[np.minimum(size, 8)]
    h = mix(h)
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < LONG:
        lane = lanes[start[more] + k] & _LANE[np.minimum(size[more] - k, 8)]
        h[more] = mix(h[more] * _JOIN[seed] + lane)
        k += 8
        more = more[size[more] > k]
    for w in more.tolist():
        rest = xxhash.xxh3_64_intdigest(data[start[w] + LONG : end[w]].tobytes(), int(_SEEDS[seed]))
        h[w : w + 1] = mix(h[w : w + 1] * _JOIN[seed] + np.uint64(rest))
    return h


def join(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of two neighbours."""
    return mix(a * _JOIN[seed] + b)


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Which runs of bytes of a equal those of b."""
    size = a_end - a_start
    out = size == b_end - b_start
    at = np.flatnonzero(out & (size > 0))
    if len(at):
        n = size[at]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = a[np.repeat(a_start[at], n) + step] == b[np.repeat(b_start[at], n) + step]
        out[at] = np.logical_and.reduceat(equal, first)
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; a null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(offsets: np.ndarray, limit: int = 0) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most `limit` bytes together, or one row."""
    limit = limit or CHUNK_BYTES
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def packed_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Runs of bytes that follow each other, as a binary column."""
    step = np.zeros(len(data) + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    return pack(data[inside], np.concatenate([[0], np.cumsum(end - start)]))


@dataclass
class Chunk:
    """Words of some rows: row r has words doc[r] to doc[r + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    _hash: dict[int, np.ndarray] = field(default_factory=dict)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """Of each word."""
        if seed not in self._hash:
            self._hash[seed] = hash_runs(self.data, self.start, self.end, seed)
        return self._hash[seed]

    @property
    def hash(self) -> np.ndarray:
        return self.hashes()

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))

    def grams(self, size: int, seed: int = 0) -> np.ndarray:
        """Hashes of the `size` words from each word on, whatever rows they lie in."""
        part, width, out, done = self.hashes(seed), 1, None, 0
        while True:
            if size & width:
                out = part if out is None else join(out[: max(0, len(part) - done)], part[done:], seed)
                done += width
            if done == size:
                return out
            part = join(part[: max(0, len(part) - width)], part[width:], seed)
            width *= 2

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of `size` words inside one row, and their hashes."""
        at = self.window_starts(size)
        return at, self.grams(size, seed)[at]

    def window_starts(self, size: int) -> np.ndarray:
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64)
        ok = np.ones(n, bool)
        last = self.doc[1:]
        for k in range(1, size):
            x = last - k
            ok[x[x >= self.doc[:-1]]] = False
        return np.flatnonzero(ok)

    def packed(self) -> pa.Array:
        """The words as a binary column."""
        return packed_runs(self.data, self.start, self.end)

    def word_ids(self) -> np.ndarray:
        """A number for each word, the same for equal bytes."""
        return self.packed().dictionary_encode().indices.to_numpy().astype(np.int64)

    def text(self, first: int, beyond: int) -> bytes:
        return self.data[self.start[first] : self.end[beyond - 1]].tobytes()


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, lower: bool = False) -> Chunk:
    """Words of rows given by bytes and offsets (from 0). A word is a run of bytes of one class; class 0 (or False) is none. lower: with A-Z lowered."""
    n = len(data)
    kind = table[data]
    inside = kind != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= kind[1:] != kind[:-1]
    ends[:-1] &= kind[1:] != kind[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Chunk(LOWER[data] if lower else data, offsets, start, end, np.searchsorted(start, offsets))


def chunks(column: pa.Array, table: np.ndarray = SPACED, lower: bool = False, limit: int = 0) -> Iterator[tuple[int, int, Chunk]]:
    """Row ranges of a column with their words."""
    data, offsets = buffers(column)
    for i, j in pieces(offsets, limit):
        yield i, j, words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table, lower)
    trim()


def distinct_by_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) in that order."""
    order = np.argsort(h)
    r = row[order]
    r = r.astype(np.uint16 if r.size and r.max() < 65536 else np.uint32)
    by = np.argsort(r, kind="stable")
    order, r = order[by], r[by]
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new].astype(np.int64), h[new]


def blobs(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column of packed arrays, and n+1 offsets in numbers."""
    data, offsets = buffers(column)
    return np.frombuffer(data.tobytes(), kind), offsets // np.dtype(kind).itemsize


def pack(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose row i packs values[offsets[i]:offsets[i+1]]."""
    size = values.dtype.itemsize
    kind, step = (pa.binary(), np.int32) if len(values) * size < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer((offsets * size).astype(step)), pa.py_buffer(np.ascontiguousarray(values))])
