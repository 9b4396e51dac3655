"""Token ids as Arrow files of equal-length sequences.

A dataset is a folder of shards in ascending doc_id order. A shard is an Arrow IPC file
with two fixed-size-list columns: `ids` (16 bits where the vocabulary allows, else 32) and
`mask` (one bit, false on the padding that ends the shard). Sequence k of a batch is a
slice of one buffer, so a memory-mapped shard gives any sequence without a copy. Beside
it, an index file holds doc_id, the first token in the shard, and the number of tokens.
The manifest has one row a shard, with the tokens before it.

Order comes from ranges of doc_id, then of the text's length and hash, and a sort inside each
range, so no task holds more than a range, however many rows share a doc_id or have none,
and no shard waits for another. A task writes to a name of its own and only
those of tasks that succeeded are in the manifest, so lost executors leave no trace in it.

Results for odd input: a null text has no ids but the end id; null doc_ids come first;
rows that repeat a doc_id follow each other, shorter texts first; an empty table gives a
dataset without shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .bpe import Cache, encode_chunk, splitter, text_chunks
from .shared import partitions, work_folder

LENGTH, BATCH = 1024, 256
MANIFEST = "part int, path string, index_path string, n_docs long, n_tokens long"
_CACHES: dict[str, Cache] = {}


def _cache(path: str) -> Cache:
    """Words that this Python process has encoded, kept from task to task up to a bound."""
    if path not in _CACHES:
        _CACHES[path] = Cache(splitter(path))
    return _CACHES[path]


def with_end(ids: np.ndarray, rows: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of texts with an id at the end of each."""
    if end_id is None:
        return ids, rows
    return np.insert(ids, rows[1:], end_id), rows + np.arange(len(rows))


def width(path: str, end_id: int | None) -> int:
    return 2 if splitter(path).library.get_vocab_size() <= 65536 and (end_id or 0) < 65536 else 4


def write_dataset(docs: DataFrame, path: str, folder: str, end_id: int | None = 1, length: int = LENGTH) -> DataFrame:
    """Writes the shards; returns the manifest: MANIFEST and start, the tokens in earlier shards."""
    spark = docs.sparkSession
    w = width(path, end_id)
    kind = pa.uint16() if w == 2 else pa.uint32()
    schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
    manifest = pa.schema([("part", pa.int32()), ("path", pa.string()), ("index_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = fs.FileSystem.from_uri(folder)
        disk.create_dir(root)
        name = f"{root}/{uuid.uuid4().hex}"
        dtype = np.uint16 if w == 2 else np.uint32
        out = index = None
        rest, total, n_docs = np.zeros(0, dtype), 0, 0
        s, cache = splitter(path), _cache(path)

        def put(flat: np.ndarray, real: int) -> None:
            mask = np.arange(len(flat)) < real
            out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))

        for b in batches:
            if b.num_rows and out is None:
                out = pa.ipc.new_file(disk.open_output_stream(f"{name}.arrow"), schema)
                index = pa.ipc.new_file(disk.open_output_stream(f"{name}.index"), pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
            for i, j, texts, plain in text_chunks(b.column("text")):
                ids, rows = with_end(*encode_chunk(s, cache, texts, plain), end_id)
                index.write_batch(pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(rows[:-1] + total), pa.array(np.diff(rows))], names=["doc_id", "start", "n_tokens"]))
                total += len(ids)
                n_docs += j - i
                rest = np.concatenate([rest, ids.astype(dtype)])
                step = length * BATCH
                full = len(rest) // step * step
                for k in range(0, full, step):
                    put(rest[k : k + step], step)
                rest = rest[full:]
        if out is None:
            return
        if len(rest):
            put(np.concatenate([rest, np.zeros(-len(rest) % length, dtype)]), len(rest))
        out.close()
        index.close()
        scheme = folder.split("://")[0] + "://" if "://" in folder else ""
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((TaskContext.get().partitionId(), f"{scheme}{name}.arrow", f"{scheme}{name}.index", n_docs, total), manifest.types, strict=True)], schema=manifest)

    text = F.col("text").cast("string")
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).alias("size"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("size"), F.asc("hash"), F.asc("row")]
    ranges = keys.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = ranges.select("doc_id", "text").mapInArrow(write, MANIFEST).collect()  # a row a shard
    rows.sort(key=lambda r: r.part)
    starts = np.concatenate([[0], np.cumsum([r.n_tokens for r in rows], dtype=np.int64)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, starts, strict=False)], MANIFEST + ", start long").repartition(max(1, len(rows)), "part")


def open_shard(path: str) -> pa.ipc.RecordBatchFileReader:
    """The shard's reader; on a local disk it is memory-mapped."""
    disk, name = fs.FileSystem.from_uri(path)
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(disk, fs.LocalFileSystem) else disk.open_input_file(name))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, without a copy, and mask of the k-th sequence of a shard."""
    batch = reader.get_batch(k // BATCH)
    row = k % BATCH
    size = batch.schema.field("ids").type.list_size
    ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)[row * size : (row + 1) * size]
    return ids, batch.column("mask").flatten().slice(row * size, size).to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start and n_tokens of every document as the files have them, with ids or ids_crc32."""
    kind = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index_path, base in zip(b.column("path").to_pylist(), b.column("index_path").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard, index = open_shard(path), open_shard(index_path)
                flat, loaded, low = np.zeros(0, np.uint32), 0, 0
                for k in range(index.num_record_batches):
                    rows = index.get_batch(k)
                    start, size = rows.column("start").to_numpy(), rows.column("n_tokens").to_numpy()
                    if not len(start):
                        continue
                    flat, low = flat[start[0] - low :], int(start[0])  # tokens of documents already returned go
                    more = [flat]
                    have = len(flat)
                    while have < start[-1] + size[-1] - low:
                        batch = shard.get_batch(loaded)
                        x = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
                        more.append(x[batch.column("mask").flatten().to_numpy(zero_copy_only=False)])
                        have += len(more[-1])
                        loaded += 1
                    flat = np.concatenate(more)
                    cells = [flat[s - low : s - low + n].astype("<u4") for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                    last = pa.array([zlib.crc32(x.tobytes()) for x in cells], pa.int64()) if digest else pa.array([x.tolist() for x in cells], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(start + base), rows.column("n_tokens"), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return manifest.select("path", "index_path", "start").mapInArrow(run, kind)


def write_and_read(docs: DataFrame, path: str, end_id: int = 1, digest: bool = True) -> DataFrame:
    return read_documents(write_dataset(docs, path, work_folder(docs.sparkSession), end_id), digest)
