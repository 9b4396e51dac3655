"""MinHash near-dedup with sequential Bayesian verification.

A document is the set of its distinct 3-word shingles. Documents whose sets are equal (by
number and two sums over independent hashes, 128 bits) form a class, and one row of it goes
on. Its signature has 125 minima, in 25 bands of 5; a link of similarity 0.85 or more shares
no band once in 2 million. Candidates are compared by batches of 25 minima: after each, a
pair goes once the posterior probability (from a uniform prior) that its similarity reaches
the threshold is below MISS; survivors are verified on the sets of their whole texts, whose
shingles are compared by their words' bytes, not by hashes.

No bucket is turned into all its pairs. First every member meets the smallest id of its
bucket, and the links found are joined to components. Only buckets that still hold more
than one component go on: their members meet inside the bucket, in tiles of TILE members
so that a hot bucket spreads over many tasks, only across components, and only survivors
of the batches that join something new leave a task; where one of these fails, a second
round takes all that is then still apart. Links inside a component can't change the result.

Results for odd input: a text without words has no shingles and no link; one of fewer
than 3 words is one shingle; a null doc_id takes part in nothing, has no component and is
kept; rows that repeat a doc_id are judged by their own texts, so that an unrelated text
under a removed copy's doc_id stays; an empty table gives an empty result; ties go to the
smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import components
from .shared import BROADCAST_IDS, ROW_KEY, cut, keyed, on_key, partitions, without_rows

SHINGLE, BANDS, ROWS, BATCH = 3, 25, 5, 25
NUMERATOR, DENOMINATOR = 85, 100
MISS, TILE, GROUP = 1e-9, 2048, 16_384
TILES = ("bucket", "i", "j")
_SIZE = BANDS * ROWS
_ODD = np.random.Generator(np.random.PCG64(7)).integers(0, 2**31, _SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = np.uint64(0x5851F42D4C957F2D)


def shingles(c: tk.Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) by row, as two independent hashes of the shingle's bytes."""
    n, at = np.diff(c.doc), c.window_starts(size)
    short = [np.flatnonzero(n == k) for k in range(1, size)]
    row = np.concatenate([c.row[at], *short])
    both = []
    for seed in (0, 1):
        few = [tk.mix(c.grams(k, seed)[c.doc[r]] ^ np.uint64(k)) for k, r in enumerate(short, 1)]
        both.append(np.concatenate([c.grams(size, seed)[at], *few]))
    order = np.argsort(both[0])
    r = row[order].astype(np.uint16 if len(n) < 65536 else np.uint32)
    order = order[np.argsort(r, kind="stable")]
    row, h, g = row[order], both[0][order], both[1][order]
    new = np.ones(len(row), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return row[new], h[new], g[new]


def _signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), _SIZE), np.uint32)
    for k in range(_SIZE):
        out[:, k] = np.minimum.reduceat(x * _ODD[k], first)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different from band to band."""
    x = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) * _SALT
    for k in range(ROWS):
        x = tk.mix(x ^ sig[:, k::ROWS].astype(np.uint64))
    return x


def fewest_matches(n: int, threshold: float = NUMERATOR / DENOMINATOR, miss: float = MISS) -> int:
    """Pairs with fewer equal minima out of n are pruned: P(similarity >= threshold | matches) < miss."""
    for m in range(n + 1):
        # of Beta(m + 1, n - m + 1)
        if sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1)) >= miss:
            return m
    return n


_FEWEST = [(n, fewest_matches(n)) for n in range(BATCH, _SIZE + 1, BATCH)]


def survivors(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs (a[left], b[right]) of signatures outlast every batch."""
    alive = np.arange(len(left))
    same = np.zeros(len(left), np.int64)
    for n, least in _FEWEST:
        span = slice(n - BATCH, n)
        same = same + (a[left[alive], span] == b[right[alive], span]).sum(1)
        ok = same >= least
        alive, same = alive[ok], same[ok]
    return alive


def signatures(docs: DataFrame, row_keys: bool = False) -> DataFrame:
    """A number, doc_id, n_shingles, two sums that tell the set, and the signature (null without shingles)."""
    docs = keyed(docs) if row_keys else docs
    kind = "node long, doc_id long, n_shingles long, s1 long, s2 long, sig binary" + ", __k1 long, __k2 long" * row_keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j, c in tk.chunks(b.column("text"), tk.SPACED, True):
                row, h, g = shingles(c)
                n = np.bincount(row, minlength=j - i)
                some = n > 0
                first = (np.cumsum(n) - n)[some]
                s1, s2 = np.zeros((2, j - i), np.uint64)
                sig = np.zeros((0, _SIZE), np.uint32)
                if len(first):
                    s1[some], s2[some] = np.add.reduceat(tk.mix(h), first), np.add.reduceat(tk.mix(g ^ _SALT), first)
                    sig = _signatures(h, first)
                size = np.concatenate([[0], np.cumsum(some) * _SIZE])
                packed = tk.pack(sig.ravel(), size)
                cells = pc.if_else(pa.array(some), packed, pa.scalar(None, pa.binary()))
                keys = {k: b.column(k).slice(i, j - i) for k in ("__k1", "__k2")[: 2 * row_keys]}
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.arange(node, node + j - i)), "doc_id": b.column("doc_id").slice(i, j - i), "n_shingles": pa.array(n), "s1": pa.array(s1.view(np.int64)), "s2": pa.array(s2.view(np.int64)), "sig": cells} | keys)
                node += j - i

    return docs.mapInArrow(run, kind)


def _sig(column: pa.Array) -> np.ndarray:
    return tk.blobs(column, np.uint32)[0].reshape(-1, _SIZE)


def _only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the given nodes: up to BROADCAST_IDS of these, counted first, are broadcast; more are hashed in partitions, which sorts no signatures."""
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes.hint("shuffle_hash")
    return rows.join(nodes, "node", "left_semi")


def _buckets(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _bands(_sig(b.column("sig")))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("node").to_numpy(), BANDS)), pa.array(keys.ravel().view(np.int64))], names=["node", "bucket"])

    return reps.select("node", "sig").mapInArrow(run, "node long, bucket long")


def _prune(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures outlast every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.arange(b.num_rows)
            yield b.select(["a", "b"]).take(pa.array(survivors(_sig(b.column("sa")), _sig(b.column("sb")), at, at)))

    return pairs.mapInArrow(run, "a long, b long")


def _across(rows: DataFrame, groups: int, forest: bool) -> DataFrame:
    """Pairs of members of a bucket (or of two tiles) in different components that outlast every batch, with bucket and tiles.

    forest: only pairs that join what earlier pairs of the bucket haven't, so that m mutually
    similar members give m - 1 pairs and are compared about m times.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        keys = np.stack([t.column(n).to_numpy() for n in ("bucket", "i", "j")])
        order = np.lexsort(keys)
        keys = keys[:, order]
        ids, part, tile = (t.column(n).to_numpy()[order] for n in ("node", "label", "tile"))
        part = part.copy()
        sig = _sig(t.column("sig").combine_chunks())[order]
        edge = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        out = []
        for first, beyond in zip(edge, np.append(edge[1:], len(ids)), strict=True):
            i, j = keys[1:, first]
            inner = np.arange(first, beyond)
            rights = inner if i == j else inner[tile[inner] == j]
            for p in inner if i == j else inner[tile[inner] == i]:
                q = rights[(part[rights] != part[p]) & ((rights > p) if i == j else True)]
                if not len(q):
                    continue
                q = q[survivors(sig, sig, np.full(len(q), p), q)]
                if forest and len(q):
                    joined, first_of = np.unique(part[q], return_index=True)
                    q = q[first_of]
                    part[inner[np.isin(part[inner], joined)]] = part[p]
                out.append(np.stack([np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), *(np.full(len(q), k[first]) for k in keys)]))
        found = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
        return pa.table(dict(zip(("a", "b", *TILES), map(pa.array, found.astype(np.int64)), strict=True)))

    return rows.groupBy(F.pmod(F.hash(*TILES), F.lit(groups))).applyInArrow(run, "a long, b long, bucket long, i long, j long")


def exact_sets(c: tk.Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle) by row; shingles are numbered by their words' bytes, without a hash."""
    word = np.append(c.word_ids() + 1, np.zeros(size, np.int64))  # 0: no word
    n = np.diff(c.doc)
    at = np.concatenate([c.window_starts(size), *[c.doc[:-1][n == k] for k in range(1, size)]])
    row = np.searchsorted(c.doc, at, "right") - 1
    have = c.doc[row + 1] - at
    key = word[at]
    for k in range(1, size):
        key = np.unique(key << 32 | np.where(have > k, word[at + k], 0), return_inverse=True)[1]
    both = np.unique(row << 32 | key)
    return both >> 32, both & 0xFFFFFFFF


def _words(texts: pa.Array) -> tk.Chunk:
    return next(tk.chunks(texts, tk.SPACED, True, 1 << 62))[2]


def _similar(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Which rows i < n have sets similar enough to row i + n, from distinct (row, key)."""
    size, row = np.bincount(row, minlength=2 * n), row % n
    order = np.argsort(key)
    order = order[np.argsort(row[order].astype(np.uint16 if n < 65536 else np.uint32), kind="stable")]
    row, key = row[order], key[order]
    shared = np.bincount(row[1:][(key[1:] == key[:-1]) & (row[1:] == row[:-1])], minlength=n)  # a shingle of both is there twice
    return DENOMINATOR * shared >= NUMERATOR * (size[:n] + size[n:] - shared)


def _verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose whole texts are similar enough, exactly."""
    pairs = cut(pairs)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    nodes = cut(reps.select("node", "doc_id", F.col("s1").alias("own")).join(nodes, "node", "left_semi"))
    if nodes.count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where rows repeat a doc_id, those with the class's set."""
        for b in batches:
            for i, j, c in tk.chunks(b.column("text"), tk.SPACED, True):
                row, h, _ = shingles(c)
                n = np.bincount(row, minlength=j - i)
                s1, some = np.zeros(j - i, np.uint64), n > 0
                if some.any():
                    s1[some] = np.add.reduceat(tk.mix(h), (np.cumsum(n) - n)[some])
                yield b.slice(i, j - i).select(["node", "text"]).filter(pa.array(s1.view(np.int64) == b.column("own").slice(i, j - i).to_numpy()))

    texts = cut(docs.join(nodes, "doc_id").select("node", "own", "text").mapInArrow(own, "node long, text string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(tk.buffers(b.column("ta"))[1]) + np.diff(tk.buffers(b.column("tb"))[1])
            for i, j in tk.pieces(np.concatenate([[0], np.cumsum(sizes)])):
                both = pa.concat_arrays([b.column(n).slice(i, j - i) for n in ("ta", "tb")])
                # hashes that clash can only raise a similarity, so what fails by hashes fails for certain
                maybe = np.flatnonzero(_similar(*shingles(_words(both))[:2], j - i))
                if len(maybe):
                    ok = maybe[_similar(*exact_sets(_words(both.take(pa.array(np.concatenate([maybe, maybe + j - i]))))), len(maybe))]
                    yield b.slice(i, j - i).select(["a", "b"]).take(pa.array(ok))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, tile: int = TILE, local_edges: int | None = None, row_keys: bool = False) -> DataFrame:
    """One row for each of docs(doc_id, text): doc_id, n_shingles, component_id, kept, class_id (the smallest doc_id with the same set); row_keys adds the keys of shared.keyed() and a number for each group."""
    spark = docs.sparkSession
    more = {} if local_edges is None else {"local_edges": local_edges}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    set_ = ["s1", "s2", "n_shingles"]
    told = cut(signatures(docs, row_keys))
    least = told.filter("n_shingles > 0 and doc_id is not null").groupBy(*set_).agg(F.min(F.struct("doc_id", "node")).alias("x"))
    reps = cut(least.select("x.node", *set_, "x.doc_id"))  # one row stands for a set; a doc_id may stand for several
    rows = cut(_buckets(_only(told.select("node", "sig"), reps.select("node"))))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last"), F.count("*").alias("members")).filter("centre <> last").select("bucket", "centre", "members")
    members = cut(rows.join(shared, "bucket"))
    sigs = cut(_only(told.select("node", "sig"), cut(members.select("node").distinct())))
    pairs = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    links = cut(_verify(_prune(pairs), docs, reps))
    tiles = F.ceil(F.col("members") / tile)
    failed = None
    for forest in (True, False):
        label = components(links, **more)
        # members of buckets that hold several components; the centre has met all others
        labelled = cut(members.filter("members > 2").join(label.withColumnRenamed("id", "node"), "node", "left").select("bucket", "node", "centre", "members", F.coalesce("component", "node").alias("label")).filter("node <> centre"))
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("bucket")
        open_ = labelled.join(mixed, "bucket").withColumn("tile", F.pmod(F.xxhash64("node"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
        open_ = open_.select("bucket", "node", "label", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
        open_ = cut(open_ if failed is None else open_.join(failed, list(TILES), "left_semi"))
        rows = open_.count()
        if not rows:
            break
        tried = cut(_across(open_.join(sigs, "node"), max(partitions(spark), -(-rows // GROUP)), forest))
        good = cut(_verify(tried.select("a", "b").distinct(), docs, reps))
        links = links.union(good)
        # a pair left out by the forest is needed only where one of the forest has failed: there a second round takes all
        failed = tried.join(good, ["a", "b"], "left_anti").select(*TILES).distinct()
    label = components(links, **more).withColumnRenamed("id", "node")
    classes = reps.select("node", *set_, F.col("doc_id").alias("class_id")).join(label, "node", "left")
    classes = classes.withColumn("component", F.coalesce("component", "node"))
    lowest = classes.join(label.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("class_id").alias("lowest"))
    classes = classes.join(lowest, "component", "left").select(*set_, "component", "class_id", F.coalesce("lowest", "class_id").alias("lowest"))
    out = told.drop("sig", "node").join(classes, set_, "left")
    known = F.col("doc_id").isNotNull()
    own = F.when(known, F.coalesce("lowest", "doc_id"))
    keys = ["__k1", "__k2", F.when(known, F.col("component")).alias("component")] if row_keys else []
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"), *keys)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with all its columns, of each group of near duplicates one row: that of the smallest doc_id, and of several such rows the first by a hash of text and other columns. Rows without doc_id or words stay."""
    found = cut(near_duplicates(docs, row_keys=True))
    left = without_rows(docs, found.filter("not kept"))
    same = found.filter("kept and component is not null").select(*ROW_KEY, "component")
    again = cut(same.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component"))
    if not again.limit(1).count():  # no doc_id stands for two rows of a group
        return left
    named = [c for c, kind in left.dtypes if not kind.startswith("map")]
    marked = keyed(left)
    marked = marked.join(same.join(again, "component").select(*ROW_KEY, "component").distinct().toDF("__d", "__x1", "__x2", "__c"), on_key(marked, "__d", "__x1", "__x2"), "left")
    place = F.row_number().over(Window.partitionBy("__c").orderBy("__k1", "__k2", F.xxhash64(*[F.col(f"`{c}`") for c in named])))
    one = marked.filter("__c is not null").withColumn("__n", place).filter("__n = 1")
    return marked.filter("__c is null").select(*[F.col(f"`{c}`") for c in left.columns]).unionByName(one.select(*[F.col(f"`{c}`") for c in left.columns]))
