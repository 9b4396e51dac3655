"""Removal of near-duplicate texts or paragraphs by their n-grams.

`exact` is the parallel way: a unit goes if more than `percent` of its n-grams occur in an
earlier unit, or earlier in itself. `sequential` is the order-dependent one, a Bloom filter
over one ordered stream, in which a unit that goes leaves no trace.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashes import gram_hashes, murmur3_all, murmur3_grams, murmur3_mixed, word_hashes
from ..schema import PARAGRAPH_START
from .paragraphs import Flat, lengths, slices


def unit_grams(units: DataFrame, n: int = 8) -> DataFrame:
    """unit, pos, gram of units(unit, words array)."""
    at = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>"))
    return units.select("unit", F.posexplode(F.transform(at, lambda i: F.array_join(F.slice("words", i, n), " "))).alias("pos", "gram"))


#: Words whose n-grams are hashed at once; a worker takes about 150 bytes for each.
SLICE_WORDS = 200_000


def hashed_grams(units: DataFrame, n: int = 8) -> DataFrame:
    """unit, g1, g2: the distinct n-grams of each of units(unit, words array), as two hashes of their words."""
    schema = T.StructType([units.schema["unit"], T.StructField("g1", T.LongType()), T.StructField("g2", T.LongType())])
    most = SLICE_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for b in batches for x in slices(b, lengths(b.column("words")), most)):
            lists = b.column("words")
            size = lengths(lists)
            coded = lists.flatten().dictionary_encode()
            one, two = word_hashes(coded.dictionary)
            at = coded.indices.to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            start = np.flatnonzero(np.arange(len(at)) + n <= np.repeat(np.cumsum(size), size))
            g1, g2 = (gram_hashes(h[at], n)[start] for h in (one, two))
            key = np.stack([row[start].astype(np.uint64), g1, g2])
            order = np.lexsort(key)
            key = key[:, order]
            new = np.ones(len(order), bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
            yield pa.RecordBatch.from_arrays([b.column("unit").take(pa.array(key[0, new].astype(np.int64))), pa.array(key[1, new].view(np.int64)), pa.array(key[2, new].view(np.int64))], names=["unit", "g1", "g2"])

    return units.select("unit", "words").mapInArrow(run, schema)


def exact(units: DataFrame, n: int = 8, percent: int = 30) -> DataFrame:
    """unit, grams, seen, kept of units(unit, words array); order is that of unit.

    The first unit of each n-gram has it fresh, once; all else is seen. Only 16 bytes and
    the unit of each distinct n-gram of a unit are shuffled. Units shorter than n have no
    n-gram and stay.
    """
    first = hashed_grams(units, n).groupBy("g1", "g2").agg(F.min("unit").alias("unit"))
    fresh = first.groupBy("unit").agg(F.count("*").alias("fresh"))
    total = units.select("unit", F.greatest(F.size("words") - n + 1, F.lit(0)).cast("long").alias("grams"))
    out = total.join(fresh, "unit", "left").withColumn("seen", F.col("grams") - F.coalesce("fresh", F.lit(0)))
    return out.select("unit", "grams", "seen", (100 * F.col("seen") <= percent * F.col("grams")).alias("kept"))


class Bloom:
    """A Bloom filter of n-grams that can take back the last unit."""

    #: n-grams whose keys are computed at once, so that they stay in a processor's cache.
    CHUNK = 8192

    def __init__(self, total: int, n: int = 8, threshold: float = 0.3, rate: float = 0.01) -> None:
        size = ceil(-total * log(rate) / log(2) ** 2)
        self.k = ceil(size / total * log(2))
        self.m = ceil(self.k / log(2) * total)
        self.bits = np.zeros((self.m + 7) // 8, np.uint8)
        self.n, self.threshold = n, threshold

    def keys(self, mixed: np.ndarray) -> np.ndarray:
        """k rows, a column for the n-gram from each word on that has as many after it, of murmur3_mixed() words: numbers of bits."""
        grams = max(len(mixed) - self.n + 1, 0)
        out, m = np.empty((self.k, grams), np.uint64), np.uint64(self.m)
        for i in range(0, grams, self.CHUNK):
            part = mixed[i : min(i + self.CHUNK, grams) + self.n - 1]
            for j in range(self.k):
                x = murmur3_grams(part, self.n, 2 * j + 1).astype(np.uint64)
                x <<= np.uint64(32)
                x |= murmur3_grams(part, self.n, 2 * j)
                x -= x // m * m  # a division by one number is faster than a remainder
                out[j, i : i + self.CHUNK] = x
        return out

    def places(self, keys: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte and bit of each key, and whether no earlier n-gram of its unit has the key; unit: that of each n-gram."""
        first = np.zeros(keys.size, bool)
        if keys.size:
            shift = np.uint64(keys.size.bit_length())
            if self.m.bit_length() + int(shift) > 64:
                raise ValueError("too many n-grams for one slice")
            found = np.sort((keys.T.ravel() << shift) | np.arange(keys.size, dtype=np.uint64))
            at = (found & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
            found >>= shift
            row = unit[at // self.k]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            first[at[new]] = True
        return (keys >> np.uint64(3)).astype(np.int64), np.uint8(1) << (keys & np.uint64(7)).astype(np.uint8), np.ascontiguousarray(first.reshape(-1, self.k).T)

    def duplicate(self, words: list[str]) -> bool:
        """Whether a unit goes; if it stays, its n-grams are remembered."""
        keys = self.keys(murmur3_mixed(murmur3_all(pa.array(words, pa.string()))))
        return self.goes(*self.places(keys, np.zeros(keys.shape[1], np.int64)))

    def goes(self, byte: np.ndarray, bit: np.ndarray, first: np.ndarray) -> bool:
        """duplicate() of a unit by the places of its n-grams' keys.

        An n-gram is seen if each of its bits is set by an earlier unit or by an earlier n-gram
        of this one, all of whose bits are set in any case: it is fresh if it is the first that
        has some bit which no earlier unit set.
        """
        total = byte.shape[1]
        if not total:
            return False
        new = (self.bits[byte] & bit) == 0
        new &= first
        if (total - int(np.count_nonzero(new.any(axis=0)))) / total > self.threshold:
            return True
        np.bitwise_or.at(self.bits, byte[new], bit[new])
        return False


def mixed_words(texts: DataFrame, paragraphs: bool = False) -> DataFrame:
    """texts with tokens; `__mixed` has 4 bytes for each token's form, `__size` the tokens of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = Flat(b, PARAGRAPH_START if paragraphs else 0)
            coded = flat.form.dictionary_encode(null_encoding="encode")
            with np.errstate(over="ignore"):
                mixed = murmur3_mixed(murmur3_all(coded.dictionary))[coded.indices.to_numpy()]
            end = np.concatenate([[0], np.cumsum(flat.size)])
            cells = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(4 * end), pa.py_buffer(np.ascontiguousarray(mixed))])
            units = np.concatenate([[0], np.cumsum(np.bincount(flat.row[flat.first], minlength=b.num_rows))])
            sizes = pa.ListArray.from_arrays(pa.array(units, pa.int32()), pa.array(np.bincount(flat.unit, minlength=len(flat.first)), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, sizes, cells.cast(pa.binary())], names=[*b.schema.names, "__size", "__mixed"])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("__size", T.ArrayType(T.IntegerType())), T.StructField("__mixed", T.BinaryType())]))


def gram_count(texts: DataFrame, n: int = 8) -> int:
    """n-grams of all texts with tokens, repeats included: a filter of this size holds any of them at its rate."""
    return texts.agg(F.coalesce(F.sum(F.greatest(F.size("tokens").cast("long") - n + 1, F.lit(0).cast("long"))), F.lit(0))).first()[0]


#: Tokens of one slice of a batch, whose keys and places take about 200 bytes each; slices that are prepared ahead, one a thread.
SLICE_TOKENS, AHEAD = 50_000, 3


def sequential(texts: DataFrame, total: int, n: int = 8, threshold: float = 0.3, paragraphs: bool = False, order: str = "text_id", counted: bool = False) -> DataFrame:
    """texts with tokens, in order, without duplicate texts (or paragraphs): one task by design.

    Words are hashed in all tasks; the one task gets 4 bytes a word, and threads of it compute
    the keys of the texts that come next. With `counted`, `n` is the number of tokens left in
    place of `tokens`, which then aren't moved.
    """
    rows = mixed_words(texts, paragraphs)
    kind = T.StructType([T.StructField("n", T.IntegerType()) if counted and f.name == "tokens" else f for f in texts.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Bloom(total, n, threshold)

        def key(b: pa.RecordBatch) -> tuple:
            sizes = b.column("__size").flatten().to_numpy()
            keys = seen.keys(np.frombuffer(b"".join(b.column("__mixed").to_pylist()), np.uint32))
            return b, sizes, seen.places(keys, np.repeat(np.arange(len(sizes)), sizes)[: keys.shape[1]])

        parts = (x for b in batches for x in slices(b, pc.binary_length(b.column("__mixed")).to_numpy().astype(np.int64) // 4, SLICE_TOKENS))
        with ThreadPoolExecutor(AHEAD) as pool:
            waiting = deque(pool.submit(key, x) for x in islice(parts, AHEAD))
            while waiting:
                b, sizes, places = waiting.popleft().result()
                waiting.extend(pool.submit(key, x) for x in islice(parts, 1))
                at, keep = 0, []
                for size in sizes.tolist():
                    keep.append(size < n or not seen.goes(*[x[:, at : at + size - n + 1] for x in places]))
                    at += size
                per = pc.list_value_length(b.column("__size")).to_numpy()
                left = np.bincount(np.repeat(np.arange(len(per)), per), weights=sizes * np.array(keep, bool), minlength=len(per)).astype(np.int32)
                cells = {f: b.column(f) for f in b.schema.names}
                if counted:
                    cells["n"] = pa.array(left)
                else:
                    tokens = b.column("tokens").flatten().filter(pa.array(np.repeat(np.array(keep, bool), sizes)))
                    cells["tokens"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), tokens)
                yield pa.RecordBatch.from_arrays([cells[f] for f in kind.names], names=kind.names).filter(pa.array(left > 0))

    return (rows.drop("tokens") if counted else rows).repartition(1).sortWithinPartitions(order).mapInArrow(run, kind)


def exact_copies(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, copy_of: the smallest key with the same text."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    first = texts.groupBy(digest.alias("digest")).agg(F.min(key).alias("copy_of"))
    return texts.select(key, digest.alias("digest")).join(first, "digest").select(key, "copy_of")


def paragraphs_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, para, text: the non-empty lines of a text."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("para", "line")).filter("line <> ''").select(key, "para", F.col("line").alias("text"))


def earlier_in_group(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("__n = 1").drop("__n")
