"""Substring dedup with prefix-partitioned suffix trees.

Two documents share a passage of WINDOW words or more where the suffix tree of all texts has
an internal node at that depth. The tree is sparse and built in parts. Of every WINDOW words
the anchor is the leftmost run of GRAM words with the smallest hash; equal windows have equal
anchors at equal places, so suffixes need to start at anchors only, if each carries the words
before it that its windows reach. These suffixes go to a group by a prefix of variable
length: the anchor, or where many suffixes start with it all words of the window
(`prefix_plan`, counted over all texts, which also sets the number of groups so that each
holds about GROUP suffixes). A group numbers its words by their bytes and ranks its suffixes
by prefix doubling; runs of equal rank at depth WINDOW are its deep internal nodes. The
smallest doc_id below a node keeps the words, all others lose them. Nodes that follow each
other in a text and in its source make up a maximal repeat.

Most suffixes have no partner, and a first pass finds which can: anchors of one document
alone rule out their windows. Copies inside the texts that a task holds at a time are joined
before the shuffle, by two independent 64-bit hashes of the window's bytes: only the smallest
doc_id's suffixes enter a group, the others know already what they lose and to whom.

Results for odd input: a null text has no words; a null doc_id is neither source nor
target of a removal; rows that repeat a doc_id are the same document, so none of them is
removed on the other's account; words and texts may have any length; of equal windows in
the smallest doc_id the first place counts as the source; an empty table gives an empty
result. Rows that repeat both doc_id and text meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import partitions

WINDOW, GRAM = 13, 6
SLOTS, HEAVY, GROUP, PART_BYTES, HOLD = 1 << 16, 1_000_000, 100_000, 4 << 20, 1_500_000
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
ANCHORS = "bucket int, known boolean, docs binary, parts binary, keys binary"
SHARED = "part int, docs binary, keys binary"
SUFFIXES = "bucket int, docs binary, parts binary, rows binary, places binary, sizes binary, text binary"
REPEATS = "part int, docs binary, rows binary, runs binary, sources binary"
_PLACE = np.dtype([("first", "<u4"), ("windows", "<u4")])
_RUN = np.dtype([("first", "<u4"), ("windows", "<u4"), ("source_first", "<u4")])
FOUND = "array<struct<first:long,n_words:long,source_id:long,source_first:long>>"


def _anchors(c: tk.Chunk, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window, and place and hash of its anchor."""
    at = c.window_starts(window)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    low = c.grams(gram)
    place, span, need = np.arange(len(low)), 1, window - gram + 1
    while span < need:
        step = min(span, need - span)
        less = low[step:] < low[: len(low) - step]
        low, place = np.where(less, low[step:], low[: len(low) - step]), np.where(less, place[step:], place[: len(place) - step])
        span += step
    return at, place[at], low[at]


def _arrow_schema(kind: str) -> pa.Schema:
    types = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, types[t]) for n, t in (x.split() for x in kind.split(", "))])


def _edges(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _by(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of entries by small numbers, where each group begins (and the end), and the groups."""
    order = np.argsort(group.astype(np.uint16) if len(group) and group.max() < 65536 else group, kind="stable")
    first = _edges(group[order])
    return order, np.append(first, len(group)), group[order][first]


def _docs_packed(docs: np.ndarray, off: np.ndarray) -> pa.Array:
    """Each blob: the least id, the width of the differences, the differences."""
    out = []
    for i, j in zip(off[:-1], off[1:], strict=True):
        d = docs[i:j]
        low = d.min()
        span = int(d.max()) - int(low)
        kind = np.uint16 if span < 1 << 16 else np.uint32 if span < 1 << 32 else np.uint64
        out.append(np.array([low, np.dtype(kind).itemsize], np.int64).tobytes() + (d - low).astype(kind).tobytes())
    return pa.array(out, pa.binary())


def _docs(column: pa.ChunkedArray) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for x in column.to_pylist():
        low, width = np.frombuffer(x, np.int64, 2)
        out.append(np.frombuffer(x, f"u{width}", offset=16).astype(np.int64) + low)
    return np.concatenate(out)


def _flat(column: pa.ChunkedArray, kind: np.dtype | type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _least(docs: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (doc, key) entries: order by key and doc, where keys begin, and the place in the order of each entry's key."""
    order = np.lexsort((docs, *keys[::-1]))
    edge = np.zeros(len(order), bool)
    edge[:1] = True
    for k in keys:
        edge[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(edge)
    return order, first, np.repeat(first, np.diff(np.append(first, len(order))))


def prefix_plan(docs: DataFrame, window: int, gram: int, heavy: int) -> tuple[np.ndarray, int, int]:
    """Slots of anchors that more than `heavy` suffixes start with, how many suffixes there are, and the bytes of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for _, _, c in tk.chunks(b.column("text")):
                size += len(c.data)
                _, place, key = _anchors(c, window, gram)
                total += np.bincount((key[_edges(place)] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slot, -1).astype(np.int32)), pa.array(np.append(total[slot], size))], names=["slot", "n"])

    found = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS + 1 rows
    slot, n = found.column("slot").to_numpy(), found.column("n").to_numpy()
    return np.sort(slot[(n > heavy) & (slot >= 0)]), int(n[slot >= 0].sum()), int(n[slot < 0].sum())


class _Texts:
    """Rows of batches, with null doc_ids told apart."""

    def __init__(self, b: pa.RecordBatch) -> None:
        self.valid = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        self.ids = b.column("doc_id").fill_null(0).to_numpy()
        self.part, self.key = b.column("part").to_numpy(), b.column("row").to_numpy()


def _ranks(word: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the `size` words from each word on, by prefix doubling."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = min(len(a), len(b))
        return np.unique(a[:n] << 32 | b[:n], return_inverse=True)[1]

    part, width, out, done = word, 1, None, 0
    while True:
        if size & width:
            out = part if out is None else pair(out, part[done:])
            done += width
        if done == size:
            return out
        part = pair(part, part[width:])
        width *= 2


def _normal(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each followed by a space, and where words begin (and the end)."""
    size = c.end - c.start
    off = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(off[-1], 0x20, np.uint8)
    inner = np.ones(off[-1], bool)
    inner[off[1:] - 1] = False
    out[inner] = tk.buffers(c.packed())[0]
    return out, off


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _told(part: np.ndarray, doc: np.ndarray, row: np.ndarray, first: np.ndarray, source: np.ndarray, source_first: np.ndarray, chain: np.ndarray) -> pa.RecordBatch:
    """Windows to remove, in the order of their texts, as runs by part: chain tells which texts' windows may follow each other."""
    new = np.ones(len(doc), bool)
    new[1:] = (chain[1:] != chain[:-1]) | (first[1:] != first[:-1] + 1) | (source[1:] != source[:-1]) | (source_first[1:] != source_first[:-1] + 1)
    at = np.flatnonzero(new)
    run = np.zeros(len(at), _RUN)
    run["first"], run["windows"], run["source_first"] = first[at], np.diff(np.append(at, len(doc))), source_first[at]
    order, off, parts = _by(part[at])
    at = at[order]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), _docs_packed(doc[at], off), tk.pack(row[at], off), tk.pack(run[order], off), tk.pack(source[at], off)], schema=_arrow_schema(REPEATS))


def _lookup(have: tuple[np.ndarray, ...], want: tuple[np.ndarray, ...]) -> np.ndarray:
    """The place in have (unique pairs) of each of want (pairs), or -1."""
    mixed, wanted = (tk.mix(b.astype(np.uint64) ^ tk.mix(a.astype(np.uint64))) for a, b in (have, want))
    out = np.full(len(wanted), -1)
    if len(mixed):
        order = np.argsort(mixed)
        at = order[np.minimum(np.searchsorted(mixed[order], wanted), len(order) - 1)]
        ok = (have[0][at] == want[0]) & (have[1][at] == want[1])
        out[ok] = at[ok]
    return out


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts by part, runs of windows to remove by part) of docs(doc_id, text); carry keeps the other columns, as `rest`."""
    spark = docs.sparkSession
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] if carry else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*rest).alias("rest")] if rest else []))
    slots, suffixes, size = prefix_plan(texts, window, gram, heavy)
    n_buckets = max(partitions(spark), suffixes // GROUP + 1)
    n_parts = max(partitions(spark), size // PART_BYTES + 1)
    row = F.xxhash64("text")
    texts = texts.withColumns({"row": row, "part": F.pmod(F.xxhash64("doc_id", row), F.lit(n_parts)).cast("int")})
    anchor_schema, suffix_schema = _arrow_schema(ANCHORS), _arrow_schema(SUFFIXES)
    narrow = np.uint16 if n_parts < 65536 else np.uint32

    def emit(bucket: np.ndarray, known: bool, d: np.ndarray, p: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            order, off, buckets = _by(bucket)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(np.full(len(buckets), known)), _docs_packed(d[order], off), tk.pack(p[order].astype(narrow), off), tk.pack(k[order], off)], schema=anchor_schema)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of each text: those that another text here has are known to be shared, and of each the smallest doc_id asks the others."""
        hold: list[tuple[np.ndarray, ...]] = []

        def put() -> Iterator[pa.RecordBatch]:
            d, p, k = (np.concatenate(x) for x in zip(*hold, strict=True))
            hold.clear()
            order, first, low = _least(d, k)
            last = np.append(first[1:], len(order))[np.searchsorted(first, low)] - 1 if len(first) else low
            d, p, k = d[order], p[order], k[order]
            many = d[low] != d[last]
            yield from emit(p[many] % n_buckets, True, d[many], p[many], k[many])
            least = np.zeros(len(d), bool)
            least[first] = True
            # one entry speaks for all rows of its doc_id, unless it is the only doc_id here
            least |= ~many
            yield from emit((k[least] % np.uint64(n_buckets)).astype(np.int64), False, d[least], p[least], k[least])
            tk.trim()

        held = 0
        for b in batches:
            rows = _Texts(b)
            for i, j, c in tk.chunks(b.column("text")):
                _, place, key = _anchors(c, window, gram)
                at = _edges(place)
                r = np.searchsorted(c.doc, place[at], "right") - 1
                ok = rows.valid[i:j][r]
                r, k = tk.distinct_by_row(r[ok], key[at][ok])
                hold.append((rows.ids[i:j][r], rows.part[i:j][r], k))
                held += len(k)
                if held > HOLD:
                    yield from put()
                    held = 0
        if held:
            yield from put()

    def shared(t: pa.Table) -> pa.Table:
        known = t.filter(t.column("known"))
        t = t.filter(pa.compute.invert(t.column("known")))
        d, p, k = _docs(t.column("docs")), _flat(t.column("parts"), narrow), _flat(t.column("keys"), np.uint64)
        if len(k):
            order, first, low = _least(d, k)
            last = np.append(first[1:], len(order))[np.searchsorted(first, low)] - 1
            d, p, k = d[order], p[order], k[order]
            hit = d[low] != d[last]
            d, p, k = d[hit], p[hit], k[hit]
        d, p, k = np.concatenate([d, _docs(known.column("docs"))]), np.concatenate([p, _flat(known.column("parts"), narrow)]), np.concatenate([k, _flat(known.column("keys"), np.uint64)])
        order, off, parts = _by(p)
        return pa.Table.from_arrays([pa.array(parts.astype(np.int32)), _docs_packed(d[order], off), tk.pack(k[order], off)], schema=_arrow_schema(SHARED))

    def candidates(left: pa.Table, right: pa.Table) -> Iterator[tuple[pa.RecordBatch | None, pa.RecordBatch | None]]:
        want = np.unique(np.rec.fromarrays([_docs(right.column("docs")), _flat(right.column("keys"), np.uint64)], names="d,k"))
        want = np.ascontiguousarray(want["d"]), np.ascontiguousarray(want["k"])
        left = left.filter(pa.compute.is_in(left.column("doc_id"), pa.array(np.unique(want[0])))) if len(want[0]) else left.slice(0, 0)
        for b in left.to_batches():
            rows = _Texts(b)
            for i, j, c in tk.chunks(b.column("text")):
                at, place, key = _anchors(c, window, gram)
                row = np.searchsorted(c.doc, at, "right") - 1
                d = rows.ids[i:j][row]
                keep = rows.valid[i:j][row]
                keep[keep] = _lookup(want, (d[keep], key[keep])) >= 0
                at, place, key, row, d = at[keep], place[keep], key[keep], row[keep], d[keep]
                if not len(at):
                    continue
                both = [c.grams(window, seed)[at] for seed in (0, 1)]
                order, _, low = _least(d, *both)  # of equal doc_ids the first place comes first
                source = np.empty(len(at), np.int64)
                source[order] = order[low]
                first = at - c.doc[row]
                lost = d[source] < d
                told = None
                if lost.any():
                    src = source[lost]
                    told = _told(rows.part[i:j][row[lost]], d[lost], rows.key[i:j][row[lost]], first[lost], d[src], first[src], row[lost])
                at, place, key, row, full, first = at[~lost], place[~lost], key[~lost], row[~lost], both[0][~lost], first[~lost]
                hot = np.isin((key % np.uint64(SLOTS)).astype(np.int64), slots)
                new = np.ones(len(at), bool)
                new[1:] = hot[1:] | (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
                begin = np.flatnonzero(new)
                windows = np.diff(np.append(begin, len(at)))
                bucket = np.where(hot, full, key)[begin] % np.uint64(n_buckets)
                raw, off = _normal(c)
                x, y = off[at[begin]], off[at[begin] + windows + window - 1]
                order, bounds, buckets = _by(bucket.astype(np.int64))
                begin, windows, x, y = begin[order], windows[order], x[order], y[order]
                spot = np.zeros(len(begin), _PLACE)
                spot["first"], spot["windows"] = first[begin], windows
                size = np.concatenate([[0], np.cumsum(y - x)])
                r = row[begin]
                cells = [pa.array(buckets.astype(np.int32)), _docs_packed(rows.ids[i:j][r], bounds), tk.pack(rows.part[i:j][r].astype(narrow), bounds), tk.pack(rows.key[i:j][r], bounds), tk.pack(spot, bounds), tk.pack((y - x).astype(np.uint32), bounds), tk.pack(raw[_ranges(x, y - x)], size[bounds])]
                yield pa.RecordBatch.from_arrays(cells, schema=suffix_schema), told

    def suffix_rows(left: pa.Table, right: pa.Table) -> pa.Table:
        """Suffixes by group, and what is lost already, by part (as groups below 0)."""
        out = []
        for rows, told in candidates(left, right):
            out.append(rows)
            if told is not None:
                out.append(pa.RecordBatch.from_arrays([pa.array(-1 - told.column("part").to_numpy()), told.column("docs"), pa.nulls(told.num_rows, pa.binary()), told.column("rows"), told.column("runs"), told.column("sources"), pa.nulls(told.num_rows, pa.binary())], schema=suffix_schema))
        return pa.Table.from_batches(out, schema=suffix_schema)

    def tree(t: pa.Table) -> pa.Table:
        """The nodes of a group."""
        d, p, key = _docs(t.column("docs")), _flat(t.column("parts"), narrow).astype(np.int64), _flat(t.column("rows"), np.int64)
        spot, size = _flat(t.column("places"), _PLACE), _flat(t.column("sizes"), np.uint32).astype(np.int64)
        c = tk.words(np.frombuffer(b"".join(t.column("text").to_pylist()), np.uint8), np.concatenate([[0], np.cumsum(size)]))
        at = c.window_starts(window)
        rank = _ranks(c.word_ids(), window)[at]
        row = np.searchsorted(c.doc, at, "right") - 1
        first = spot["first"][row].astype(np.int64) + at - c.doc[row]
        order = np.lexsort((first, d[row], rank))
        edge = _edges(rank[order])
        source = np.empty(len(at), np.int64)
        source[order] = order[np.repeat(edge, np.diff(np.append(edge, len(order))))]
        lost = np.flatnonzero(d[row[source]] < d[row])
        src, row = source[lost], row[lost]
        return pa.Table.from_batches([_told(p[row], d[row], key[row], first[lost], d[np.searchsorted(c.doc, at[src], "right") - 1], first[src], row)])

    found = texts.select("doc_id", "text", "row", "part").mapInArrow(anchors, ANCHORS).groupBy("bucket").applyInArrow(shared, SHARED)
    sent = texts.select("doc_id", "text", "row", "part").groupBy("part").cogroup(found.groupBy("part")).applyInArrow(suffix_rows, SUFFIXES)

    def nodes(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() >= 0:
            return tree(t)
        return pa.Table.from_arrays([pa.array(-1 - t.column("bucket").to_numpy()), t.column("docs"), t.column("rows"), t.column("places"), t.column("sizes")], schema=_arrow_schema(REPEATS))

    return texts, sent.groupBy("bucket").applyInArrow(nodes, REPEATS)


def _repeats(first: np.ndarray, windows: np.ndarray, source: np.ndarray, source_first: np.ndarray, window: int) -> list[dict]:
    """Maximal repeats of one text: runs that follow each other here and in their source."""
    out: list[dict] = []
    order = np.lexsort((first, first - source_first, source))
    for f, n, s, x in zip(*(v[order].tolist() for v in (first, windows, source, source_first)), strict=True):
        if out and out[-1]["source_id"] == s and out[-1]["source_first"] - out[-1]["first"] == x - f and out[-1]["first"] + out[-1]["n_words"] - window + 1 == f:
            out[-1]["n_words"] += n
        else:
            out.append({"first": f, "n_words": n + window - 1, "source_id": s, "source_first": x})
    return sorted(out, key=lambda x: x["first"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False, heavy: int = HEAVY, carry: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text).

    With digest: doc_id, n_words, n_removed, kept_sha256. Else doc_id, n_words, n_removed,
    kept_text (the text itself where nothing goes, else the kept words joined by a space),
    spans (word ranges removed, as "first-last" joined by commas) and repeats (the maximal
    repeats with their sources). carry adds the other columns of docs as a struct `rest`.
    """
    texts, lost = removals(docs, window, gram, heavy, carry)
    kind = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept_text string, spans string")
    schema = _arrow_schema(kind)
    if not digest:
        one = pa.struct([(n, pa.int64()) for n in ("first", "n_words", "source_id", "source_first")])
        schema = schema.append(pa.field("repeats", pa.list_(one)))
        kind += f", repeats {FOUND}"
    out_type = T._parse_datatype_string(kind)
    carry = "rest" in texts.columns
    if carry:
        out_type = out_type.add(texts.schema["rest"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        have = _docs(right.column("docs")), _flat(right.column("rows"), np.int64)
        run, source = _flat(right.column("runs"), _RUN), _flat(right.column("sources"), np.int64)
        order = np.lexsort((have[1], have[0]))
        have, run, source = (have[0][order], have[1][order]), run[order], source[order]
        edge = np.flatnonzero(np.concatenate([[True], (have[0][1:] != have[0][:-1]) | (have[1][1:] != have[1][:-1])])) if len(run) else np.zeros(0, np.int64)
        off, heads = np.append(edge, len(run)), (have[0][edge], have[1][edge])
        out, rest = [], left.column("rest") if carry else None
        for b in left.to_batches():
            rows = _Texts(b)
            there = b.column("text").is_valid().to_numpy(zero_copy_only=False)
            mine = _lookup(heads, (rows.ids, rows.key))
            mine[~rows.valid] = -1
            for i, j, c in tk.chunks(b.column("text")):
                step = np.zeros(len(c.start) + 1, np.int64)
                hit = np.flatnonzero(mine[i:j] >= 0)
                h = mine[i:j][hit]
                many = off[h + 1] - off[h]
                at = _ranges(off[h], many)
                begin = np.repeat(c.doc[hit], many) + run["first"][at]
                np.add.at(step, begin, 1)
                np.add.at(step, begin + run["windows"][at] + window - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                raw, total = c.data.tobytes(), np.concatenate([[0], np.cumsum(gone)])
                removed = total[c.doc[1:]] - total[c.doc[:-1]]
                cells: list[list] = [[], [], []]
                for r in range(j - i):
                    x, y = c.doc[r], c.doc[r + 1]
                    whole = not removed[r]
                    if whole and not digest:
                        cells[0].append(raw[c.offsets[r] : c.offsets[r + 1]].decode() if there[i + r] else None)
                        cells[1].append("")
                        cells[2].append([])
                        continue
                    if whole:
                        text = b" ".join(raw[c.offsets[r] : c.offsets[r + 1]].split())  # bytes.split() has the same six separators
                    else:
                        keep = ~gone[x:y]
                        text = b" ".join([raw[s:e] for s, e in zip(c.start[x:y][keep].tolist(), c.end[x:y][keep].tolist(), strict=True)])
                    if digest:
                        cells[0].append(hashlib.sha256(text).hexdigest())
                    else:
                        flips = np.flatnonzero(np.diff(np.concatenate([[0], gone[x:y].view(np.int8), [0]])))
                        k = slice(off[mine[i + r]], off[mine[i + r] + 1])
                        cells[0].append(text.decode())
                        cells[1].append(",".join(f"{s}-{e - 1}" for s, e in zip(flips[::2], flips[1::2], strict=True)))
                        cells[2].append(_repeats(*(run[n][k].astype(np.int64) for n in ("first", "windows")), source[k], run["source_first"][k].astype(np.int64), window))
                cols = [b.column("doc_id").slice(i, j - i), pa.array(np.diff(c.doc)), pa.array(removed)] + [pa.array(x, f.type) for x, f in zip(cells, list(schema)[3:], strict=False)]
                out.append(pa.RecordBatch.from_arrays(cols, schema=schema))
        t = pa.Table.from_batches(out, schema=schema)
        return t.append_column("rest", rest) if carry else t

    return texts.groupBy("part").cogroup(lost.groupBy("part")).applyInArrow(finish, out_type)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with all its columns; the texts lack the repeated words, and n_chars, if there, is their length."""
    names = docs.columns
    found = remove_repeats(docs, window, carry=True)
    cells = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    out = found.select(*[cells[n].alias(n) if n in cells else F.col(f"rest.`{n}`").alias(n) for n in names], F.col("n_removed").alias("__removed"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("__removed")
