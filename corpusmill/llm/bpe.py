"""BPE encoding and decoding through a table of distinct words.

Spark splits the texts into words by the vocabulary's own pattern. A task takes the texts
chunk by chunk and numbers each chunk's distinct words; these, once a chunk so that frequent
words make no hot key, go to the table of distinct words, which is partitioned by the words'
hashes: each partition holds a word once, by its bytes, and encodes it once. The ids go back
to the chunks that asked and are joined with the words' positions, which stay in an Arrow
file that the task wrote to the shared folder (a failed attempt's file is never named by
anyone). Nothing is broadcast. Decoding joins ids with the table of pieces, one row an id,
whose size the vocabulary fixes and which every worker holds as an array: the join is a take.

The library's own encoder serves texts that hold a special token, or code points that the
Unicode tables here don't know, since its tables may be newer. Vocabularies that normalise
text, and texts of more than LONG_TEXT characters (whose words would be one huge row), are
split in Python by the same pattern.

Results for odd input: a null text is empty and has no ids; a null doc_id stays null; rows
that repeat a doc_id are encoded one by one; a word of any length is a word; an empty table
gives an empty result. docs must give the same rows if read again, as a written table does.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import partitions, work_folder

CHUNK_WORDS, LONG_TEXT, GATHERED = 2_000_000, 1 << 22, 1 << 18
#: How the two kinds of vocabulary split a text; word_bounds() follows them.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_UNKNOWN: list = []
_LOADED: dict[str, Splitter] = {}


def _unknown() -> regex.Pattern:
    if not _UNKNOWN:
        spans: list[list[int]] = []
        for cp in range(sys.maxunicode + 1):
            if unicodedata.category(chr(cp)) == "Cn":
                if spans and spans[-1][1] == cp - 1:
                    spans[-1][1] = cp
                else:
                    spans.append([cp, cp])
        _UNKNOWN.append(regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"))
    return _UNKNOWN[0]


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


SPACE, LETTER, NUMBER, OTHER = range(4)
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point."""
    if not _CLASSES:
        every, out = "".join(map(chr, range(sys.maxunicode + 1))), np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        _CLASSES.append(out)
    return _CLASSES[0]


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    table = _classes()
    out = table[:256][data]
    for low, beyond, size, bits in ((0xC0, 0xE0, 2, 31), (0xE0, 0xF0, 3, 15), (0xF0, 0xF8, 4, 7)):
        at = np.flatnonzero((data >= low) & (data < beyond))
        if len(at):
            cp = (data[at] & bits).astype(np.int64)
            for k in range(1, size):
                cp = (cp << 6) | (data[at + k] & 63)
            kind = table[cp]
            for k in range(size):
                out[at + k] = kind
    return out


def _contractions(data: np.ndarray, at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Letters (0, 1 or 2) that follow each apostrophe and belong to it; room: bytes after it in its text."""
    padded = np.append(data, np.zeros(2, np.uint8))
    a, b = padded[at + 1], padded[at + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (room >= 1)
    two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (room >= 2)
    return np.where(one, 1, np.where(two, 2, 0))


def word_bounds(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts, as the two patterns above split them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _byte_classes(data)
    lead = (data & 0xC0) != 0x80
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    edges = np.unique(offsets[offsets < n])
    begin[edges] = True
    if lower:
        begin |= kind == NUMBER
    begin &= lead
    if not lower:
        found = np.flatnonzero(begin)
        beyond = np.append(found[1:], n)
        run = kind[found] == SPACE
        first, beyond = found[run], beyond[run]
    at = np.flatnonzero((data == ord("'")) & begin)
    if len(at):
        end = np.append(edges, n)[np.searchsorted(edges, at, "right")]
        more = _contractions(data, at, end - at - 1)
        if not lower:
            spaced = (at > 0) & (data[at - 1] == 0x20) & ~np.isin(at, edges)
            more[spaced] = 0
        at, more, end = at[more > 0], more[more > 0], end[more > 0]
        begin[at + 1] = False
        at += more + 1
        begin[at[at < end]] = True
    if not lower and len(first):
        # white space before a word: its last character stands alone or, if a space, opens the word
        inner = ~np.isin(beyond, edges) & (beyond < n)
        beyond = beyond[inner]
        last = beyond - 1
        for _ in range(3):
            last = np.where(lead[last], last, last - 1)
        begin[last] = True
        begin[beyond[data[last] == 0x20]] = False
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    if lower:
        word = kind[start] != SPACE
        start, end = start[word], end[word]
    return start, end


class Splitter:
    """Words of a text as the tokenizer file splits it, and ids of a word."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.lower = self.library.normalizer is not None
        self.hints = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.letters = {i: c for i, c in enumerate(_byte_letters())}
        self.model = self.library.model

    def normal(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower() if self.lower else text

    def chunk(self, texts: list[str | None], plain: bool) -> tuple[pa.Array, np.ndarray, dict[int, list[int]]]:
        """The words of all texts; offsets of the rows into them; ids of the texts that the library has to encode."""
        parts, own = [], {}
        for r, text in enumerate(texts):
            if text and ((not plain and _unknown().search(text)) or ("<|" in text and any(x in text for x in self.hints))):
                own[r] = self.whole(text)
                text = ""
            parts.append(self.normal(text).encode() if text else b"")
        data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        start, end = word_bounds(data, offsets, self.lower)
        return tk.packed_runs(data, start, end), np.searchsorted(start, offsets), own

    def ids_of(self, word: bytes) -> list[int]:
        if word.isalnum():  # such bytes stand for themselves, and a space for one other letter
            letters = word.decode("ascii")
        elif word[:1] == b" " and word[1:].isalnum():
            letters = self.letters[0x20] + word[1:].decode("ascii")
        else:
            letters = word.decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


def splitter(path: str) -> Splitter:
    if path not in _LOADED:
        _LOADED[path] = Splitter(path)
    return _LOADED[path]


class Cache:
    """Ids of words, by their bytes."""

    def __init__(self, split: Splitter, most: int = 200_000) -> None:
        self.split, self.most = split, most
        self.reset()

    def reset(self) -> None:
        self.places: dict[bytes, int] = {}
        self.flat, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def look(self, words: pa.Array) -> np.ndarray:
        """Places of the words in flat and off."""
        if len(self.places) > self.most:
            self.reset()
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.places.get, known, repeat(-1)), np.int64, len(known))
        new = np.flatnonzero(at < 0)
        if len(new):
            words = [known[i] for i in new.tolist()]
            base = len(self.places)
            self.places.update(zip(words, range(base, base + len(words)), strict=True))
            flat, off = encode_words(self.split, words)
            self.flat = np.concatenate([self.flat, flat])
            self.off = np.concatenate([self.off, self.off[-1] + off[1:]])
            at[new] = np.arange(base, base + len(new))
        return at[coded.indices.to_numpy()]


def encode_words(split: Splitter, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and offsets."""
    ids = [split.ids_of(w) for w in words]
    off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
    return np.fromiter(chain.from_iterable(ids), np.int32, int(off[-1])), off


def gather(flat: np.ndarray, off: np.ndarray, index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values flat[off[i]:off[i+1]] of each index, and where the rows, given by offsets into index, then begin; GATHERED of the index at a time."""
    size, bounds, parts, total = off[1:] - off[:-1], np.zeros(len(rows), np.int64), [flat[:0]], 0
    for i in range(0, len(index), GATHERED):
        part = index[i : i + GATHERED]
        ends = np.cumsum(size[part])
        at = np.repeat(off[1:][part] - ends, size[part])
        at += np.arange(len(at))
        parts.append(flat[at])
        mine = slice(*np.searchsorted(rows, [i, i + len(part)], "right"))
        bounds[mine] = total + ends[rows[mine] - i - 1]
        total += len(at)
    return np.concatenate(parts), bounds


def encode_chunk(split: Splitter, cache: Cache, texts: list[str | None], plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and offsets."""
    words, rows, own = split.chunk(texts, plain)
    at = cache.look(words)
    ids, rows = gather(cache.flat, cache.off, at, rows)
    if own:
        parts = [np.array(own[r], np.int32) if r in own else ids[rows[r] : rows[r + 1]] for r in range(len(texts))]
        ids, rows = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return ids, rows


def text_chunks(column: pa.Array, limit: int = tk.CHUNK_BYTES) -> Iterator[tuple[int, int, list[str | None], bool]]:
    """Row ranges with their texts, and whether no byte is 0xCA or above."""
    data, offsets = tk.buffers(column)
    for i, j in tk.pieces(offsets, limit):
        yield i, j, column.slice(i, j - i).to_pylist(), not (data[offsets[i] : offsets[j]] >= 0xCA).any()
    tk.trim()


class Pieces:
    """Of each id: its bytes, and its digits."""

    def __init__(self, path: str) -> None:
        library = splitter(path).library
        back = {c: i for i, c in enumerate(_byte_letters())}
        vocab = library.get_vocab()
        size = max(vocab.values()) + 1
        parts = [b""] * size
        for piece, i in vocab.items():
            # letters that stand for no byte stay as they are
            parts[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        self.bytes = pa.array(parts, pa.binary())
        self.digits = pa.array([str(i) for i in range(size)], pa.string())

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> list[bytes]:
        lists = pa.LargeListArray.from_arrays(pa.array(rows, pa.int64()), self.bytes.take(pa.array(ids)))
        return [x.as_py() for x in pc.binary_join(lists, b"")]

    def joined(self, ids: np.ndarray, rows: np.ndarray) -> list[str]:
        lists = pa.LargeListArray.from_arrays(pa.array(rows, pa.int64()), self.digits.take(pa.array(ids)))
        return [x.as_py() for x in pc.binary_join(lists, ",")]


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def split_words(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and words of docs(doc_id, text); words is null, and text isn't, where Python has to split or the library to encode the text, as `own` tells."""
    s = splitter(path)
    text = F.coalesce("text", F.lit(""))
    if s.lower:
        return docs.select("doc_id", text.alias("text"), F.lit(None).cast("array<string>").alias("words"), F.lit(False).alias("own"))
    own = text.rlike(r"\p{Cn}")
    for token in s.hints:
        own = own | text.contains(token)
    plain = ~own & (F.length(text) <= LONG_TEXT)
    words = F.when(plain, F.regexp_extract_all(text, F.lit("(?U)" + BYTE_SPLIT), F.lit(0)))
    return docs.select("doc_id", F.when(~plain, text).alias("text"), words.alias("words"), own.alias("own"))


_ASK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("path", pa.string()), ("batch", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary())])
_ASKED = "bucket int, chunk long, path string, batch int, sizes binary, words binary"
_TOLD = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("path", pa.string()), ("batch", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])
_PLANES = ("p0", "p1", "p2", "p3")
_CHUNK = pa.schema([("doc_id", pa.list_(pa.int64())), ("sizes", pa.list_(pa.uint32())), ("ids", pa.list_(pa.int32())), *[(p, pa.list_(pa.uint8())) for p in _PLANES]])


def _narrow(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Small numbers as bytes, behind a byte that tells their width."""
    out = []
    for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        wide = j > i and values[i:j].max() > 255
        out.append((b"\4" + values[i:j].astype(np.uint32).tobytes()) if wide else (b"\1" + values[i:j].astype(np.uint8).tobytes()))
    return pa.array(out, pa.binary())


def _numbers(cells: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64) for x in cells]


class _Writer:
    """Numbers the words of chunks, keeps their positions in a file, and yields the words by bucket."""

    def __init__(self, folder: str, buckets: int) -> None:
        disk, root = fs.FileSystem.from_uri(folder)
        disk.create_dir(root)
        name = f"{root}/{uuid.uuid4().hex}.arrow"
        self.path = (folder.split("://")[0] + "://" if "://" in folder else "") + name
        self.out = pa.ipc.new_file(disk.open_output_stream(name), _CHUNK, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.chunk, self.n, self.buckets = TaskContext.get().partitionId() << 32, 0, buckets

    def head(self) -> pa.RecordBatch:
        cells = [[self.n % self.buckets], [self.chunk + self.n], [self.path], [self.n], [None], [None]]
        self.n += 1
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cells, _ASK, strict=True)], schema=_ASK)

    def put(self, doc_id: pa.Array, sizes: np.ndarray, ids: np.ndarray | None, at: np.ndarray | None) -> None:
        cells = {"doc_id": doc_id, "sizes": pa.array(sizes), "ids": None if ids is None else pa.array(ids)}
        if at is not None:  # byte by byte, which compresses better
            planes = np.ascontiguousarray(at.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
            cells |= {p: pa.array(planes[k]) for k, p in enumerate(_PLANES)}
        whole = [pa.array([None], f.type) if cells.get(f.name) is None else pa.ListArray.from_arrays(pa.array([0, len(cells[f.name])], pa.int32()), cells[f.name].cast(f.type.value_type)) for f in _CHUNK]
        self.out.write_batch(pa.RecordBatch.from_arrays(whole, schema=_CHUNK))

    def given(self, doc_id: pa.Array, ids: list[list[int]]) -> pa.RecordBatch:
        """A chunk whose ids are known."""
        self.put(doc_id, np.array([len(x) for x in ids]), np.array(list(chain.from_iterable(ids)), np.int32), None)
        return self.head()

    def add(self, doc_id: pa.Array, sizes: np.ndarray, coded: pa.DictionaryArray) -> Iterator[pa.RecordBatch]:
        """Words are numbered in the order of their buckets, so that answers need no numbers."""
        data, off = tk.buffers(coded.dictionary)
        bucket = (tk.hash_runs(data, off[:-1], off[1:]) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        self.put(doc_id, sizes, None, place[coded.indices.to_numpy()] if len(order) else place)
        first = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0])) if len(order) else order
        rows = np.append(first, len(order))
        flat, bounds = tk.buffers(coded.dictionary.take(pa.array(order)))
        none = pa.nulls(len(first))
        cells = [pa.array(bucket[order][first]), pa.array(np.full(len(first), self.chunk + self.n)), none.cast(pa.string()), none.cast(pa.int32()), _narrow(np.diff(off)[order], rows), tk.pack(flat, bounds[rows])]
        yield self.head()
        yield pa.RecordBatch.from_arrays(cells, schema=_ASK)


def asked_words(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """Of each chunk of texts, its distinct words by bucket, and a row that names its positions."""
    folder = work_folder(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, out = splitter(path), _Writer(folder, buckets)
        hold: list[tuple[pa.Array, np.ndarray, pa.DictionaryArray]] = []  # words as numbers, which take less
        held = 0

        def put() -> Iterator[pa.RecordBatch]:
            ids, sizes, words = zip(*hold, strict=True)
            yield from out.add(pa.concat_arrays(ids), np.concatenate(sizes), pa.concat_arrays(words))
            hold.clear()
            tk.trim()

        for b in batches:
            split = b.filter(b.column("words").is_valid())
            if split.num_rows:
                words = split.column("words")
                hold.append((split.column("doc_id"), words.value_lengths().to_numpy(), words.flatten().cast(pa.binary()).dictionary_encode()))
                held += len(hold[-1][2])
            rest = b.filter(b.column("words").is_null())
            whole = rest.filter(rest.column("own"))
            if whole.num_rows:
                yield out.given(whole.column("doc_id"), [s.whole(x) for x in whole.column("text").to_pylist()])
            rest = rest.filter(pc.invert(rest.column("own")))
            for i, j, texts, plain in text_chunks(rest.column("text")):
                words, rows, own = s.chunk(texts, plain)
                doc_id = rest.column("doc_id").slice(i, j - i)
                if own:
                    yield out.given(doc_id.take(pa.array([*own])), [*own.values()])
                mine = np.setdiff1d(np.arange(j - i), [*own])
                hold.append((doc_id.take(pa.array(mine)), np.diff(rows)[mine], words.dictionary_encode()))
                held += len(words)
            if held > CHUNK_WORDS:
                yield from put()
                held = 0
        if hold:
            yield from put()
        out.out.close()

    return split_words(docs, path).mapInArrow(run, _ASKED)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) to doc_id and ids, packed as int32."""
    spark = docs.sparkSession
    asked = asked_words(_texts(docs), path, 4 * partitions(spark))

    width = np.uint16 if splitter(path).library.get_vocab_size() <= 65536 else np.int32

    def table(t: pa.Table) -> pa.Table:
        """A partition of the table of distinct words: each is encoded once and goes to all chunks that asked."""
        heads = t.filter(t.column("path").is_valid())
        t = t.filter(t.column("path").is_null()).combine_chunks()
        sizes = _numbers(t.column("sizes").to_pylist())
        rows = np.concatenate([[0], np.cumsum([len(x) for x in sizes], dtype=np.int64)])
        length = np.concatenate([np.zeros(0, np.int64), *sizes])
        words = tk.pack(np.frombuffer(b"".join(t.column("words").to_pylist()), np.uint8), np.concatenate([[0], np.cumsum(length)])).dictionary_encode()
        flat, off = encode_words(splitter(path), words.dictionary.to_pylist())
        ids, bounds = gather(flat, off, words.indices.to_numpy(), np.arange(len(words) + 1))
        told = pa.Table.from_arrays([*(t.column(n) for n in ("bucket", "chunk", "path", "batch")), _narrow(np.diff(bounds), rows), tk.pack(ids.astype(width), bounds[rows])], schema=_TOLD)
        empty = pa.nulls(heads.num_rows).cast(pa.binary())
        return pa.concat_tables([told, pa.Table.from_arrays([*(heads.column(n) for n in ("bucket", "chunk", "path", "batch")), empty, empty], schema=_TOLD)])

    def join(t: pa.Table) -> pa.Table:
        """Ids of a chunk's words come back to their positions."""
        named = t.filter(t.column("path").is_valid()).to_pylist()
        if len(named) != 1:
            raise RuntimeError("the texts have changed while they were encoded; write them to a table first")
        disk, name = fs.FileSystem.from_uri(named[0]["path"])
        file = pa.ipc.open_file(pa.memory_map(name) if isinstance(disk, fs.LocalFileSystem) else disk.open_input_file(name))
        chunk = file.get_batch(named[0]["batch"])
        doc_id, rows = chunk.column("doc_id").flatten(), np.concatenate([[0], np.cumsum(chunk.column("sizes").flatten().to_numpy(), dtype=np.int64)])
        if chunk.column("ids").is_valid()[0].as_py():
            ids = chunk.column("ids").flatten().to_numpy()
        else:
            t = t.filter(t.column("path").is_null()).sort_by("bucket")
            many = np.concatenate([np.zeros(0, np.int64), *_numbers(t.column("sizes").to_pylist())])
            flat = np.frombuffer(b"".join(t.column("ids").to_pylist()), width)
            at = np.stack([chunk.column(p).flatten().to_numpy() for p in _PLANES], axis=1).view("<u4").ravel()
            ids, rows = gather(flat, np.concatenate([[0], np.cumsum(many)]), at, rows)
        tk.trim()
        return pa.table({"doc_id": doc_id, "ids": tk.pack(ids.astype(np.int32), rows).cast(pa.binary())})

    told = asked.groupBy("bucket").applyInArrow(table, "bucket int, chunk long, path string, batch int, sizes binary, ids binary")
    return told.groupBy("chunk").applyInArrow(join, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and packed ids to doc_id, ids as a list, and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        for b in batches:
            for i, j in tk.pieces(tk.buffers(b.column("ids"))[1], 1 << 20):
                ids, rows = tk.blobs(b.column("ids").slice(i, j - i), np.int32)
                text = [x.decode("utf-8", "replace") for x in p.decode(ids, rows)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids)), pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids joined by commas and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        for b in batches:
            for i, j in tk.pieces(tk.buffers(b.column("ids"))[1], 1 << 20):
                ids, rows = tk.blobs(b.column("ids").slice(i, j - i), np.int32)
                joined = [hashlib.sha256(x.encode()).hexdigest() for x in p.joined(ids, rows)]
                text = [hashlib.sha256(_valid(x)).hexdigest() for x in p.decode(ids, rows)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.diff(rows)), pa.array(joined), pa.array(text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _valid(x: bytes) -> bytes:
    return x.decode("utf-8", "replace").encode()
