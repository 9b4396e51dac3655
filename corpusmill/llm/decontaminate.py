"""Benchmark decontamination with suffix arrays of the training texts.

Each task turns its texts, a bounded shard at a time, into a word-level suffix array:
suffixes sorted by their first WINDOW words. Words are numbered by the benchmark's
vocabulary, by their bytes and not by hashes, and suffixes that don't start with a pair of
words that starts a window of the benchmark match at most one of its words, so they are left
out before the sort. Every benchmark suffix of WINDOW words or more (or short item) is then
searched in it, all at once, by binary search; the interval found holds all its occurrences.
Runs of consecutive occurrences give the longest verbatim matches with their places; words
inside an occurring window are hit.

The benchmark goes to the tasks as Arrow files in the shared folder, written by tasks in
blocks of at most BLOCK bytes (or one item). A task holds one block at a time; if there are
several, it meets each with up to HOLD bytes of texts before the next, so neither side has
to fit.

Results for odd input: a null or wordless text has no words and no window; an item of
fewer than WINDOW words is one window; items that share an item_id are one item; the
windows of an item with a null item_id hit words, but it isn't counted or listed; a null
doc_id stays null; repeated documents are judged one by one; empty tables give no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import work_folder

WINDOW, BLOCK, SHARD_BYTES, HOLD = 10, 16 << 20, 2 << 20, 24 << 20
_BLOCK: dict[str, Block] = {}


class Block:
    """Windows of some items, over the numbers of their words."""

    def __init__(self, names: pa.Array, texts: pa.Array, window: int) -> None:
        self.names = names.to_pylist()
        _, _, c = next(iter(tk.chunks(texts, tk.ALNUM, True, 1 << 62)), (0, 0, None))
        if c is None:
            c = tk.words(np.zeros(0, np.uint8), np.zeros(1, np.int64), tk.ALNUM)
        coded = c.packed().dictionary_encode()
        self.vocab = coded.dictionary
        word = np.append(coded.indices.to_numpy(), np.full(window, -1, np.int32))
        n = np.diff(c.doc)
        at = np.concatenate([c.window_starts(window), c.doc[:-1][(n > 0) & (n < window)]])
        self.item = np.searchsorted(c.doc, at, "right") - 1
        self.first = at - c.doc[self.item]
        self.size = np.minimum(n[self.item] - self.first, window)
        self.keys = word[at[:, None] + np.arange(window)]
        self.keys[np.arange(window) >= self.size[:, None]] = -1
        self.many = self.size > 1
        self.pair = self.keys[:, 0].astype(np.int64) << 32 | (self.keys[:, 1] if window > 1 else 0)
        self.pairs = np.unique(self.pair[self.many])
        self.single = np.zeros(len(self.vocab) + 1, bool)
        self.single[self.keys[~self.many, 0]] = True


def write_blocks(benchmark: DataFrame, block: int = BLOCK) -> list[str]:
    """Files with the benchmark's items, each of at most `block` bytes or one item."""
    folder = work_folder(benchmark.sparkSession)
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    schema = pa.schema([("item_id", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = fs.FileSystem.from_uri(folder)
        disk.create_dir(root)
        hold: list[pa.RecordBatch] = []

        def put() -> pa.RecordBatch:
            name = f"{root}/{uuid.uuid4().hex}.arrow"
            with disk.open_output_stream(name) as f, pa.ipc.new_file(f, schema) as out:
                for b in hold:
                    out.write_batch(b)
            hold.clear()
            return pa.RecordBatch.from_pydict({"path": [scheme + name]})

        total = 0
        for b in batches:
            offsets = tk.buffers(b.column("text"))[1]
            for i, j in tk.pieces(offsets, block):
                size = int(offsets[j] - offsets[i])
                if hold and total + size > block:
                    yield put()
                    total = 0
                hold.append(b.slice(i, j - i).cast(schema))
                total += size
        if hold:
            yield put()

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return sorted(r.path for r in items.filter("text is not null").coalesce(1 if block >= BLOCK else 4).mapInArrow(run, "path string").collect())  # a row a block


def _load(path: str, window: int) -> Block:
    """The last block that this Python process used stays."""
    key = f"{window} {path}"
    if key not in _BLOCK:
        _BLOCK.clear()
        disk, name = fs.FileSystem.from_uri(path)
        with disk.open_input_stream(name) as f:
            t = pa.ipc.open_file(f.read()).read_all().combine_chunks()
        _BLOCK[key] = Block(*(x.chunk(0) if x.num_chunks else pa.array([], pa.string()) for x in (t.column("item_id"), t.column("text"))), window)
    return _BLOCK[key]


def _sort(word: np.ndarray, at: np.ndarray, beyond: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the suffixes at the given words, which end before `beyond`: their order, and their first words."""
    spot = at[:, None] + np.arange(window)
    keys = np.append(word, np.full(window, -1, np.int32))[spot]
    keys[spot >= beyond[:, None]] = -1
    order = np.lexsort(keys.T[::-1])
    return at[order], keys[order]


def _bound(keys: np.ndarray, wanted: np.ndarray, size: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all wanted prefixes of `size` words in sorted suffixes."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    span = np.arange(wanted.shape[1])
    for _ in range(int(len(keys)).bit_length()):
        mid = (low + high) >> 1
        x = keys[np.minimum(mid, len(keys) - 1)]
        differ = (x != wanted) & (span < size[:, None])
        first = differ.argmax(1)
        rows = np.arange(len(wanted))
        some = differ[rows, first]
        less = np.where(some, x[rows, first] < wanted[rows, first], right)
        open_ = low < high
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def _occurrences(c: tk.Chunk, block: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, window of the block) where the window occurs."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(c.start) or not len(block.size):
        return none
    word = pc.index_in(c.packed(), value_set=block.vocab).fill_null(-1).to_numpy()
    able = block.single[word]
    if len(block.pairs) and len(word) > 1:
        known = (word[:-1] >= 0) & (word[1:] >= 0)
        last = c.doc[1:] - 1
        known[last[(last >= 0) & (last < len(known))]] = False
        spot = np.flatnonzero(known)
        pair = word[spot].astype(np.int64) << 32 | word[spot + 1]
        at = np.minimum(np.searchsorted(block.pairs, pair), len(block.pairs) - 1)
        able[spot[block.pairs[at] == pair]] = True
    at = np.flatnonzero(able)
    if not len(at):
        return none
    beyond = c.doc[np.searchsorted(c.doc, at, "right")]
    at, suffixes = _sort(word, at, beyond, window)
    # windows whose first pair no suffix here has can't be found
    here = suffixes[:, 0].astype(np.int64) << 32 | (suffixes[:, 1] if window > 1 else 0)
    try_ = np.flatnonzero(~block.many | np.isin(block.pair, here))
    low, high = (_bound(suffixes, block.keys[try_], block.size[try_], right) for right in (False, True))
    n = high - low
    found = np.flatnonzero(n)
    n = n[found]
    spot = np.repeat(low[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return at[spot], try_[np.repeat(found, n)]


Hits = list[tuple[np.ndarray, np.ndarray, Block]]


def _scan(batches: Iterator[pa.RecordBatch], text: int | str, paths: list[str], window: int) -> Iterator[tuple[pa.RecordBatch, tk.Chunk, Hits]]:
    """Slices of the batches with their words and the occurrences of all blocks."""
    hold: list[tuple[pa.RecordBatch, tk.Chunk, Hits]] = []
    size = 0

    def search() -> Iterator[tuple[pa.RecordBatch, tk.Chunk, Hits]]:
        for path in paths:
            block = _load(path, window)
            for _, c, hits in hold:
                at, w = _occurrences(c, block, window)
                if len(at):
                    hits.append((at, w, block))
        yield from hold
        hold.clear()

    for b in batches:
        for i, j, c in tk.chunks(b.column(text), tk.ALNUM, True, SHARD_BYTES):
            hold.append((b.slice(i, j - i), c, []))
            size += len(c.data)
            if len(paths) < 2 or size > HOLD:
                yield from search()
                size = 0
    yield from search()


def _hit_words(c: tk.Chunk, hits: Hits) -> np.ndarray:
    """Of each row, how many words lie in an occurrence."""
    step = np.zeros(len(c.start) + 1, np.int64)
    for at, w, block in hits:
        np.add.at(step, at, 1)
        np.add.at(step, at + block.size[w], -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return total[c.doc[1:]] - total[c.doc[:-1]]


def _matches(c: tk.Chunk, at: np.ndarray, w: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal verbatim matches: first word of the chunk, window of the first word, row, and words."""
    row, item, shift = np.searchsorted(c.doc, at, "right") - 1, block.item[w], at - block.first[w]
    order = np.lexsort((at, shift, item, row))
    at, w, row, item, shift = at[order], w[order], row[order], item[order], shift[order]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at))) - 1 + block.size[w[begin]]
    return at[begin], w[begin], row[begin], length


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row for each of docs(doc_id, text): doc_id, n_words, n_hit, items, contaminated, and the words of the longest verbatim match."""
    paths = write_blocks(benchmark, block)
    kind = "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean, longest long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, c, hits in _scan(batches, "text", paths, window):
            n_hit, longest = _hit_words(c, hits), np.zeros(b.num_rows, np.int64)
            items: list[set[str]] = [set() for _ in range(b.num_rows)]
            for at, w, block in hits:
                _, first, row, length = _matches(c, at, w, block)
                np.maximum.at(longest, row, length)
                for r, x in np.unique(np.stack([row, block.item[first]]), axis=1).T.tolist():
                    if block.names[x] is not None:
                        items[r].add(block.names[x])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(c.doc)), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(n_hit > 0), pa.array(longest)], names=["doc_id", "n_words", "n_hit", "items", "contaminated", "longest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def digests(found: DataFrame) -> DataFrame:
    """contamination() with the items as a count and a SHA-256."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The maximal verbatim matches of `window` words or more, or of whole shorter items: doc_id, item_id, doc_word, item_word, n_words."""
    paths = write_blocks(benchmark)
    kind = "doc_id long, item_id string, doc_word long, item_word long, n_words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, c, hits in _scan(batches, "text", paths, window):
            for at, w, block in hits:
                at, w, row, length = _matches(c, at, w, block)
                names = pa.array([block.names[x] for x in block.item[w].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), names, pa.array(at - c.doc[row]), pa.array(block.first[w]), pa.array(length)], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark."""
    paths = write_blocks(benchmark)
    at = docs.columns.index("text")
    schema = T.StructType([T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, c, hits in _scan(batches, at, paths, window):
            yield b.filter(pa.array(_hit_words(c, hits) == 0))

    return docs.toDF(*schema.names).mapInArrow(run, schema).toDF(*docs.columns)
