"""Hashes that columns of the engine carry, vectorised where Spark has none."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U32 = np.uint32


def _rotate(x: np.ndarray, k: int) -> np.ndarray:
    return (x << _U32(k)) | (x >> _U32(32 - k))


def murmur3_words(blocks: np.ndarray, seed: int, length: int) -> np.ndarray:
    """MurmurHash3 x86 32 of rows of whole 32-bit little-endian blocks; length in bytes."""
    h = np.full(blocks.shape[0], seed, _U32)
    with np.errstate(over="ignore"):
        for k in range(blocks.shape[1]):
            h = _rotate(h ^ (_rotate(blocks[:, k] * _U32(0xCC9E2D51), 15) * _U32(0x1B873593)), 13) * _U32(5) + _U32(0xE6546B64)
        return _finish(h, length)


def _finish(h: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    h = h ^ np.asarray(length, _U32)
    h = (h ^ (h >> _U32(16))) * _U32(0x85EBCA6B)
    h = (h ^ (h >> _U32(13))) * _U32(0xC2B2AE35)
    return h ^ (h >> _U32(16))


def murmur3(data: bytes, seed: int = 0) -> int:
    with np.errstate(over="ignore"):
        whole = len(data) // 4
        h = np.array([seed], _U32)
        for b in np.frombuffer(data, "<u4", whole):
            h = _rotate(h ^ (_rotate(np.array([b], _U32) * _U32(0xCC9E2D51), 15) * _U32(0x1B873593)), 13) * _U32(5) + _U32(0xE6546B64)
        tail = int.from_bytes(data[4 * whole :], "little")
        if tail:
            h = h ^ (_rotate(np.array([tail], _U32) * _U32(0xCC9E2D51), 15) * _U32(0x1B873593))
        return int(_finish(h, len(data))[0])


def murmur3_all(words: pa.Array) -> np.ndarray:
    """murmur3() of each word, with seed 0; null counts as the empty word."""
    data = pc.fill_null(words.cast(pa.large_binary()), b"")
    out = np.zeros(len(data), _U32)
    if not len(data):
        return out
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw, size = np.frombuffer(data.buffers()[2] or b"", np.uint8), np.diff(at)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        cells = np.zeros((len(rows), -(-int(length) // 4) * 4), np.uint8)
        cells[:, :length] = raw[at[rows][:, None] + np.arange(length)]
        blocks, h = cells.view("<u4"), np.zeros(len(rows), _U32)
        for k in range(length // 4):
            h = murmur3_step(h, murmur3_mixed(blocks[:, k]))
        if length % 4:
            h = h ^ murmur3_mixed(blocks[:, -1])
        out[rows] = _finish(h, length)
    return out


def murmur3_mixed(blocks: np.ndarray) -> np.ndarray:
    """What a block adds to any hash, whatever its seed."""
    return _rotate(blocks * _U32(0xCC9E2D51), 15) * _U32(0x1B873593)


def murmur3_step(h: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return _rotate(h ^ mixed, 13) * _U32(5) + _U32(0xE6546B64)


def murmur3_grams(mixed: np.ndarray, n: int, seed: int) -> np.ndarray:
    """MurmurHash3 x86 32 of the n blocks from each block on that has as many, of murmur3_mixed() blocks."""
    size = len(mixed) - n + 1
    h, t = np.full(size, seed, _U32), np.empty(size, _U32)
    for k in range(n):
        h ^= mixed[k : k + size]
        np.right_shift(h, _U32(19), out=t)
        h <<= _U32(13)
        h |= t
        h *= _U32(5)
        h += _U32(0xE6546B64)
    return _finish(h, 4 * n)


def super_fast_hash(data: bytes) -> int:
    """Paul Hsieh's SuperFastHash."""
    m = 0xFFFFFFFF
    if not data:
        return 0
    h = len(data)
    for i in range(0, len(data) - 3, 4):
        h = (h + int.from_bytes(data[i : i + 2], "little")) & m
        t = ((int.from_bytes(data[i + 2 : i + 4], "little") << 11) ^ h) & m
        h = ((h << 16) ^ t) & m
        h = (h + (h >> 11)) & m
    rest = data[len(data) // 4 * 4 :]
    if len(rest) == 3:
        h = (h + int.from_bytes(rest[:2], "little")) & m
        h ^= (h << 16) & m
        h ^= (int.from_bytes(rest[2:], "little", signed=True) << 18) & m
        h = (h + (h >> 11)) & m
    elif len(rest) == 2:
        h = (h + int.from_bytes(rest, "little")) & m
        h ^= (h << 11) & m
        h = (h + (h >> 17)) & m
    elif len(rest) == 1:
        h = (h + int.from_bytes(rest, "little", signed=True)) & m
        h ^= (h << 10) & m
        h = (h + (h >> 1)) & m
    for k, right in ((3, False), (5, True), (4, False), (17, True), (25, False), (6, True)):
        h = (h + (h >> k)) & m if right else h ^ ((h << k) & m)
    return h


@F.pandas_udf(T.LongType())
def murmur3_column(text: pd.Series) -> pd.Series:
    known: dict[str, int] = {}
    return text.map(lambda x: None if x is None else known.setdefault(x, murmur3(x.encode()) if x not in known else 0))


def md5_64(text: Column) -> Column:
    """The first 8 bytes of the MD5, as 16 hex digits of the little-endian number."""
    h = F.md5(text.cast("binary"))
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)])


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    known = words.cast(pa.binary()).to_pylist()
    return tuple(np.array([xxhash.xxh3_64_intdigest(w, seed) for w in known], np.uint64) for seed in (0, 0x9E3779B97F4A7C15))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Of the n words from each word on (0 where there are fewer)."""
    out = np.zeros(len(h), np.uint64)
    if len(h) >= n:
        x = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x += h[k : len(h) - n + 1 + k]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[: len(x)] = x ^ (x >> np.uint64(32))
    return out
