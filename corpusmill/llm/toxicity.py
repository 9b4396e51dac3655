"""Toxicity from the nearest labelled examples.

Terms are words and their byte n-grams of 4 to 6, lower-cased. The vocabulary holds, of each
toxic example, the TERMS_EACH terms that point most surely to toxic examples (by the rank of
a two-proportion z-score on at most MOST_EXAMPLES labelled documents a class, the first by
hash; no least score, so a rare language has its terms, too). Every document becomes a
TF-IDF vector over it, with document frequencies over all documents, and meets the
examples by exact cosine: an inverted index keeps, for each term, the distinct example
vectors with it and their weights. Equal vectors are one neighbour with all their labels.
Votes are weighted by squared similarity and by how far the sample thins each class; a
monotone fit of leave-one-out votes, taken in parallel, to labels makes them
probabilities. Neighbours are the evidence.

Results for odd input: a text without terms of the vocabulary, as an empty or null one,
gets the share of toxic documents among such examples; labels that are null, of null or
unknown documents, or held out are not used; a document labelled both ways is toxic;
without toxic examples all scores are 0; rows that repeat a doc_id are scored one by one, and
as an example it is the text whose vector comes first;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import cut, partitions

MOST_EXAMPLES, TERMS_EACH, NEIGHBOURS, THRESHOLD = 6000, 10, 16, 0.3  # MOST_EXAMPLES * TERMS_EACH places fit in 16 bits
GRAMS, DENSE, BATCH = (4, 5, 6), 16, 64


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _terms(c: tk.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all words, and of all n-grams inside words."""
    yield c.row, c.hash
    size = c.end - c.start
    for g in GRAMS:
        w = np.flatnonzero(size > g)  # the word itself is there already
        many = size[w] - g + 1
        at = np.repeat(c.start[w] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        yield np.repeat(c.row[w], many), tk.hash_runs(c.data, at, at + g)


def examples(labels: DataFrame, most: int = MOST_EXAMPLES) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic) of at most `most` learnable documents a label, and the weight of one of each."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return cut(part[0].union(part[1])), {y: max(1.0, counts.get(y, 0) / most) for y in (0, 1)}


def vocabulary(docs: DataFrame, sample: DataFrame, each: int = TERMS_EACH) -> np.ndarray:
    """Sorted hashes of the terms of each toxic example that toxic examples have most surely more often."""
    spark = docs.sparkSession
    flagged = cut(docs.join(F.broadcast(sample), "doc_id").select("text", "toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column("toxic").to_numpy() == 1
            for i, j, c in tk.chunks(b.column("text"), tk.ALNUM, True):
                pairs = [tk.distinct_by_row(row, h) for row, h in _terms(c)]
                row, h = (np.concatenate(x) for x in zip(*pairs, strict=True))
                term, at = np.unique(h, return_inverse=True)
                bad = toxic[i:j][row]
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.bincount(at, bad, len(term)).astype(np.int64)), pa.array(np.bincount(at, ~bad, len(term)).astype(np.int64))], names=["term", "bad", "good"])

    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    nb, ng = n.get(1, 0), n.get(0, 0)
    if not nb:
        return np.zeros(0, np.uint64)
    found = flagged.mapInArrow(count, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter("bad > 0")
    share = (F.col("bad") + F.col("good")) / F.lit(float(nb + ng))
    z = (F.col("bad") / F.lit(float(nb)) - F.col("good") / F.lit(float(max(1, ng)))) / F.sqrt(share * (1 - share + 1e-9) * F.lit(1 / nb + 1 / max(1, ng)))
    sure = found.select("term", z.cast("float").alias("z")).filter("z > 0").toArrow()  # of the sample alone
    term, value = sure.column("term").to_numpy().view(np.uint64), sure.column("z").to_numpy()
    order = np.argsort(term)
    sent = spark.sparkContext.broadcast((term[order], value[order]))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, value = sent.value
        for b in batches:
            for _, _, c in tk.chunks(b.column("text"), tk.ALNUM, True):
                pairs = [tk.distinct_by_row(row, h) for row, h in _terms(c)]
                row, h = (np.concatenate(x) for x in zip(*pairs, strict=True))
                at = np.minimum(np.searchsorted(term, h), max(0, len(term) - 1))
                ok = np.flatnonzero(term[at] == h) if len(term) else np.zeros(0, np.int64)
                row, at = row[ok], at[ok]
                order = np.lexsort((at, -value[at], row))
                row, at = row[order], at[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(term[at[rank < each]]).view(np.int64))], names=["term"])

    best = flagged.filter("toxic = 1").select("text").mapInArrow(choose, "term long").distinct().toArrow()  # at most MOST_EXAMPLES * TERMS_EACH
    return np.sort(best.column("term").to_numpy().view(np.uint64))


def vectors(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """doc_id, terms (packed uint16 places in the vocabulary) and counts (packed uint32)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)  # at most MOST_EXAMPLES * TERMS_EACH hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mask = sent.value, np.uint64((1 << 20) - 1)
        seen = np.zeros(1 << 20, bool)
        seen[(known & mask).astype(np.int64)] = True
        for b in batches:
            for i, j, c in tk.chunks(b.column("text"), tk.ALNUM, True):
                rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for row, h in _terms(c):
                    spot = np.flatnonzero(seen[(h & mask).astype(np.int64)])
                    at = np.minimum(np.searchsorted(known, h[spot]), max(0, len(known) - 1))
                    ok = known[at] == h[spot] if len(known) else np.zeros(0, bool)
                    rows.append(row[spot[ok]])
                    terms.append(at[ok])
                both, n = np.unique(np.concatenate(rows) * 65536 + np.concatenate(terms), return_counts=True)
                off = np.searchsorted(both >> 16, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), tk.pack((both & 65535).astype(np.uint16), off), tk.pack(n.astype(np.uint32), off)], names=["doc_id", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, terms binary, counts binary")


def inverse_frequencies(vecs: DataFrame, n_terms: int) -> np.ndarray:
    """Over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(n_terms + 1, np.int64), 0
        for b in batches:
            total[:n_terms] += np.bincount(tk.blobs(b.column("terms"), np.uint16)[0], minlength=n_terms)
            n += b.num_rows
        total[n_terms] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_terms + 1)), pa.array(total)], names=["term", "n"])

    df = np.zeros(n_terms + 1)
    for r in vecs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    return np.log((1 + df[n_terms]) / (1 + df[:n_terms])) + 1


def _ranges(start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ranges start[a]:start[a + 1] one after another, and their lengths."""
    many = start[at + 1] - start[at]
    return np.repeat(start[at] - (np.cumsum(many) - many), many) + np.arange(many.sum()), many


class Index:
    """Postings of distinct example vectors, and their labels."""

    def __init__(self, rows: list[tuple[int, int, bytes, bytes]], idf: np.ndarray, weight: dict[int, float], k: int = NEIGHBOURS, block: int = DENSE) -> None:
        self.idf, self.k = idf, k
        groups: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        for doc_id, toxic, terms, counts in sorted(rows):
            groups.setdefault((terms, counts), []).append((doc_id, toxic))
        empty = groups.pop((b"", b""), [])
        self.weight = np.array([weight[0], weight[1]])
        keys = self.keys = sorted(groups)
        self.ids = [[d for d, _ in groups[x]] for x in keys]
        self.many = np.array([[sum(t == y for _, t in groups[x]) for y in (0, 1)] for x in keys], np.int64).reshape(-1, 2)
        self.votes = self.many * self.weight
        vecs = [self.vector(t, c) for t, c in keys]
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vecs)])
        row = np.repeat(np.arange(len(vecs)), [len(t) for t, _ in vecs]) if vecs else np.zeros(0, np.int64)
        w = np.concatenate([np.zeros(0), *(x for _, x in vecs)])
        self.term, self.weights, self.first = term, w, np.searchsorted(row, np.arange(len(vecs) + 1))
        order = np.argsort(term, kind="stable")
        self.row, self.w = row[order].astype(np.int32), w[order]
        self.start = np.searchsorted(term[order], np.arange(len(idf) + 1))
        # a term in one of `block` vectors, or more, has a row of weights, and these meet a batch at once
        often = np.flatnonzero(np.diff(self.start) * block >= max(1, len(keys)))
        self.dense = np.full(len(idf), -1)
        self.dense[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(keys)), np.float32)
        for i, t in enumerate(often.tolist()):
            x = slice(self.start[t], self.start[t + 1])
            self.rows[i, self.row[x]] = self.w[x]
        self.toxic = bool(self.votes[:, 1].sum()) or any(t for _, t in empty)
        total = sum(weight[t] for _, t in empty)
        self.of_empty = (sum(weight[t] for _, t in empty if t) + 0.01) / (total + 1) if empty else 0.0

    def vector(self, terms: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        t = np.frombuffer(terms, np.uint16).astype(np.int64)
        w = (1 + np.log(np.frombuffer(counts, np.uint32))) * self.idf[t]
        return t, w / np.sqrt((w**2).sum())

    def nearest(self, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest distinct vectors, of those that share a term."""
        return self.nearest_of([(t, w)])[0]

    def nearest_of(self, vecs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.keys:
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in vecs]
        sent = np.zeros((len(vecs), len(self.rows)), np.float32)
        for n, (t, w) in enumerate(vecs):
            often = self.dense[t] >= 0
            sent[n, self.dense[t[often]]] = w[often]
        near, full = sent @ self.rows, np.zeros(len(self.idf))
        out = []
        for (t, w), score in zip(vecs, near, strict=True):
            rare = self.dense[t] < 0
            if rare.any():
                i, many = _ranges(self.start, t[rare])
                score = score + np.bincount(self.row[i], np.repeat(w[rare], many) * self.w[i], len(score)).astype(np.float32)
            least = np.partition(score, len(score) - self.k)[len(score) - self.k] if len(score) > self.k else 0.0
            # all that rounding could bring among the nearest, and their cosines in doubles
            at = np.flatnonzero((score > 0) & (score >= least * (1 - 1e-4)))
            i, many = _ranges(self.first, at)
            full[t] = w
            sim = np.bincount(np.repeat(np.arange(len(at)), many), full[self.term[i]] * self.weights[i], len(at)).astype(np.float64)
            full[t] = 0
            best = np.lexsort((at, -sim))[: self.k]
            out.append((at[best], sim[best]))
        return out

    def vote(self, at: np.ndarray, sim: np.ndarray, own: int = -1, label: int = 0) -> float:
        votes = self.votes[at].copy()
        if own >= 0:
            votes[at == own, label] -= self.weight[label]
        v = (sim**2) @ votes
        return float(v[1] / v.sum()) if v.sum() > 0 else 0.0

    def left_out(self, places: list[int]) -> list[tuple[int, float, int, float]]:
        """(place, vote, label, weight) of the examples at places, each without its own vote."""
        out = []
        for n in range(0, len(places), BATCH):
            part = places[n : n + BATCH]
            for i, (at, sim) in zip(part, self.nearest_of([self.vector(*self.keys[i]) for i in part]), strict=True):
                out += [(i, self.vote(at, sim, i, y), y, float(self.votes[i, y])) for y in (0, 1) if self.many[i, y]]
        return out

    def scores(self, keys: list[tuple[bytes, bytes]], knots: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, list[int]]]:
        """Probability, and doc_ids of the nearest examples, one for each distinct vector, of each of keys."""
        if not self.toxic:
            return [(0.0, [])] * len(keys)
        out: list[tuple[float, list[int]]] = []
        for n in range(0, len(keys), BATCH):
            part = keys[n : n + BATCH]
            found = self.nearest_of([self.vector(*key) for key in part])
            out += [(float(np.clip(np.interp(self.vote(at, sim), *knots), 0, 1)), [self.ids[i][0] for i in at]) if len(at) else (self.of_empty, []) for at, sim in found]
        return out


def monotone(points: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the non-decreasing fit to points (vote, label, weight) in their order."""
    parts: list[list[float]] = []  # vote, share, weight
    for v, s, m in points:
        parts.append([v, float(s), m])
        while len(parts) > 1 and (parts[-2][1] >= parts[-1][1] or parts[-2][0] == parts[-1][0]):
            a, b = parts[-2], parts.pop()
            parts[-1] = [(a[0] * a[2] + b[0] * b[2]) / (a[2] + b[2]), (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2]]
    return np.array([p[0] for p in parts]), np.array([p[1] for p in parts])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each of docs(doc_id, text): doc_id, held_out, score, predicted, evidence."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample, weight = examples(labels)
    vocab = vocabulary(docs, sample)
    vecs = cut(vectors(docs, vocab))
    idf = inverse_frequencies(vecs, len(vocab))
    own = vecs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("terms", "counts", "toxic")).alias("x"))
    rows = [tuple(r) for r in own.select("doc_id", "x.toxic", "x.terms", "x.counts").collect()]  # at most twice MOST_EXAMPLES
    built = Index([(d, t, bytes(a), bytes(b)) for d, t, a, b in rows], idf, weight)
    index = spark.sparkContext.broadcast(built)

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = index.value.left_out(b.column("id").to_pylist())
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "vote", "label", "weight"), x, strict=True)) for x in got], schema=pa.schema([("id", pa.int64()), ("vote", pa.float64()), ("label", pa.int64()), ("weight", pa.float64())]))

    places = spark.range(0, len(built.keys), 1, partitions(spark))
    votes = places.mapInArrow(leave_out, "id long, vote double, label long, weight double").collect()  # at most two a vector
    knots = monotone([(r.vote, r.label, r.weight) for r in sorted(votes, key=lambda r: (r.vote, r.id, r.label))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], tuple[float, list[int]]] = {}
        for b in batches:
            keys = list(zip(b.column("terms").to_pylist(), b.column("counts").to_pylist(), strict=True))
            if len(known) > 20_000:
                known.clear()
            new = [key for key in dict.fromkeys(keys) if key not in known]
            known |= zip(new, index.value.scores(new, knots), strict=True)
            got = [known[key] for key in keys]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.float64()), pa.array([e for _, e in got], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    out = vecs.repartition(4 * partitions(spark)).mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
