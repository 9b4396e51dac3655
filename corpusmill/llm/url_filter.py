"""URL rules as sorted arrays of 64-bit digests.

A rule is a host with its subdomains and a path prefix, and a verdict. The xxhash64 of
host + path, sorted, is the key array; beside it lie the full rules. Arrays are written to
the shared folder in shards by leading bits, one per RULES_PER_SHARD rules, and memory-
mapped by the tasks (read where the folder isn't a local disk). A URL's candidates are its
host's suffixes combined with its path cut at each length that a rule's path has; all
candidates of a batch are searched at once, and each digest found is confirmed by
comparing the strings. The longest rule wins; of equal length the one with the longer host,
of equal rules a block.

Results for odd input: a null URL, or one without "://", has an empty host and path, which
no rule fits; URLs that no rule fits get the default verdict; a null page_id stays null;
repeated rows are judged one by one; an empty table gives an empty result; an empty list
of rules leaves the default for all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import work_folder

RULES_PER_SHARD = 4_000_000
_OPEN: dict[str, pa.Table] = {}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path of a URL column."""
    u = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _digest(x: str) -> int:
    return xxhash.xxh64_intdigest(x)


def build(rules: DataFrame, rules_per_shard: int = RULES_PER_SHARD) -> tuple[list[str | None], list[int]]:
    """Writes rules(host, path, verdict); returns the shards' files, by leading bits, and the lengths of all paths."""
    spark = rules.sparkSession
    folder = work_folder(spark)
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    n = rules.count()
    bits = max(0, (max(1, -(-n // rules_per_shard)) - 1).bit_length())
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([_digest(x + y) for x, y in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)], np.uint64)
            shard = (h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h.view(np.int64)), pa.array(shard)], names=["host", "path", "verdict", "digest", "shard"])

    def write(t: pa.Table) -> pa.Table:
        disk, root = fs.FileSystem.from_uri(folder)
        disk.create_dir(root)
        h = t.column("digest").to_numpy().view(np.uint64)
        t = t.take(pa.array(np.argsort(h, kind="stable")))
        name = f"{root}/{uuid.uuid4().hex}.arrow"
        body = pa.table({"digest": pa.array(np.sort(h)), "host": t.column("host"), "path": t.column("path"), "verdict": t.column("verdict")}).combine_chunks()
        with disk.open_output_stream(name) as f, pa.ipc.new_file(f, body.schema) as out:
            out.write_table(body)
        return pa.table({"shard": t.column("shard").slice(0, 1), "file": [scheme + name]})

    files: list[str | None] = [None] * (1 << bits)
    made = rules.mapInArrow(digest, "host string, path string, verdict string, digest long, shard int").groupBy("shard").applyInArrow(write, "shard int, file string")
    for r in made.collect():  # a row a shard
        files[r.shard] = r.file
    return files, lengths


def _shard(path: str) -> pa.Table:
    if path not in _OPEN:
        disk, name = fs.FileSystem.from_uri(path)
        _OPEN[path] = pa.ipc.open_file(pa.memory_map(name) if isinstance(disk, fs.LocalFileSystem) else disk.open_input_file(name)).read_all()
    return _OPEN[path]


def judge(urls: DataFrame, files: list[str | None], lengths: list[int], default: str = "allow") -> DataFrame:
    """urls(id, host, path) with rule and verdict."""
    bits = (len(files) - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, hosts, paths = [], [], []
            for r, (host, path) in enumerate(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)):
                if not host:
                    continue
                cuts = [path[:n] for n in lengths if n <= len(path)]
                tail = host
                while True:
                    row.extend([r] * len(cuts))
                    hosts.extend([tail] * len(cuts))
                    paths.extend(cuts)
                    _, dot, tail = tail.partition(".")
                    if not dot:
                        break
            h = np.array([_digest(x + y) for x, y in zip(hosts, paths, strict=True)], np.uint64)
            shard = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            best: dict[int, tuple] = {}
            for s in np.unique(shard).tolist():
                if files[s] is None:
                    continue
                t = _shard(files[s])
                keys = t.column("digest").chunk(0).to_numpy(zero_copy_only=True)
                mine = np.flatnonzero(shard == s)
                low, high = np.searchsorted(keys, h[mine], "left"), np.searchsorted(keys, h[mine], "right")
                for k in np.flatnonzero(high > low).tolist():
                    at = int(mine[k])
                    for x in range(low[k], high[k]):
                        host, path = t.column("host")[x].as_py(), t.column("path")[x].as_py()
                        if host == hosts[at] and path == paths[at]:
                            now = (len(host) + len(path), len(host), host + path, t.column("verdict")[x].as_py())
                            best[row[at]] = max(best.get(row[at], now), now)
            found = [best.get(r) for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x and x[2] for x in found], pa.string()), pa.array([x[3] if x else default for x in found], pa.string())], names=["id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, "id long, host string, path string, rule string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """One row a page: its id, host, path, rule (null where none fits) and verdict."""
    host, path = parts(url_column)
    files, lengths = build(rules)
    urls = pages.select(F.col(f"`{id_column}`").cast("long").alias("id"), host.alias("host"), path.alias("path"))
    return judge(urls, files, lengths, default).withColumnRenamed("id", id_column)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules given as ("host/path", verdict)."""
    return spark.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", v) for r, v in rules], "host string, path string, verdict string")
