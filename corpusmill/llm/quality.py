"""Quality classifier by importance resampling.

Two bag-of-n-grams models over SLOTS hashed unigrams and bigrams of words and punctuation,
lower-cased: one of the raw text, counted over all documents, and one of the target, counted
over documents labelled as good (at most MOST_GOOD of them, the first by hash). A document's
log-weight is the log ratio of its probabilities under the two, the sum over its n-grams.
Standard Gumbel noise, fixed by doc_id and seed, turns the k largest sums of log-weight and
noise into a sample without replacement with these weights. k is the share of good documents
among all labelled ones, taken of all documents (or a given share).

Results for odd input: a text without n-grams has log-weight 0; labels of unknown or null
documents count for nothing, and a document labelled both ways is bad; without good labels
all weights are 0 and all rows stay, and so they do without bad ones; rows that repeat a
doc_id and text share their key, and rows whose key equals the k-th largest all stay; a null
doc_id has its own fixed noise; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import cut, keyed, without_rows

SLOTS, MOST_GOOD = 1 << 16, 25_000


def _grams(c: tk.Chunk, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each unigram and bigram."""
    mask, row = np.uint64(slots - 1), c.row
    at, two = c.windows(2)
    return np.concatenate([row, row[at]]), np.concatenate([c.hash & mask, two & mask]).astype(np.int64)


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good)."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("good"))


def target_sample(labels: DataFrame, most: int = MOST_GOOD) -> DataFrame:
    """(doc_id) of at most `most` documents labelled as good, the first by hash."""
    return known_labels(labels).filter("good = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def models(docs: DataFrame, sample: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """log P(slot | target) - log P(slot | raw)."""
    sample = sample.select("doc_id", F.lit(True).alias("good"))  # at most MOST_GOOD rows
    flagged = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, slots), np.int64)
        for b in batches:
            good = b.column("good").to_numpy(zero_copy_only=False)
            for i, j, c in tk.chunks(b.column("text"), tk.TOKENS, True):
                row, slot = _grams(c, slots)
                total[0] += np.bincount(slot, minlength=slots)
                total[1] += np.bincount(slot[good[i:j][row]], minlength=slots)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[0, seen]), pa.array(total[1, seen])], names=["slot", "raw", "good"])

    rows = flagged.mapInArrow(count, "slot int, raw long, good long").groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()  # at most `slots` rows
    n = np.zeros((2, slots))
    if rows.num_rows:
        at = rows.column("slot").to_numpy()
        n[0, at], n[1, at] = rows.column("raw").to_numpy(), rows.column("good").to_numpy()
    if not n[1].sum():
        return np.zeros(slots)
    p = (n + 1) / (n.sum(1, keepdims=True) + slots)
    return np.log(p[1]) - np.log(p[0])


def gumbel(doc_id: Column, seed: int = 1) -> Column:
    """Noise that depends on doc_id and seed alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)  # SLOTS numbers
    slots = len(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, c in tk.chunks(b.column("text"), tk.TOKENS, True):
                row, slot = _grams(c, slots)
                n = np.bincount(row, minlength=j - i)
                s = np.bincount(row, sent.value[slot], minlength=j - i)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(i, j - i), "n_grams": pa.array(n), "log_weight": pa.array(s, pa.float64())} | {k: b.column(k).slice(i, j - i) for k in keys})

    keys = [c for c in ("__k1", "__k2") if c in docs.columns]
    return docs.select("doc_id", "text", *keys).mapInArrow(run, "doc_id long, n_grams long, log_weight double" + "".join(f", {k} long" for k in keys))


def kth_largest(df: DataFrame, name: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest of a column of finite numbers, by counting in ever narrower bins."""
    x = F.col(name)
    low, high = df.agg(F.min(x), F.max(x)).first()
    while True:
        width = (high - low) / bins
        inside = df.filter((x >= low) & (x <= high))
        if not width > 0 or low + width == low:
            return low
        counts = {r.b: r["count"] for r in inside.groupBy(F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).alias("b")).count().collect()}  # at most `bins` rows
        for b in sorted(counts, reverse=True):
            if k <= counts[b]:
                break
            k -= counts[b]
        chosen = inside.filter(F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) == b)
        if counts[b] <= few:
            return sorted((r[0] for r in chosen.select(x).collect()), reverse=True)[k - 1]
        new = chosen.agg(F.min(x), F.max(x)).first()
        if tuple(new) == (low, high):
            return low
        low, high = new


def select(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1, row_keys: bool = False) -> DataFrame:
    """One row for each of docs(doc_id, text): doc_id, n_grams, log_weight, sample_key, kept; row_keys adds those of shared.keyed()."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratio = models(docs, cut(target_sample(labels)))
    scored = cut(weights(keyed(docs) if row_keys else docs, ratio).withColumn("sample_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)))
    good, known, n = scored.join(known_labels(labels), "doc_id", "left").agg(F.sum("good"), F.count("good"), F.count("*")).first()
    if share is None:
        share = good / known if good else 1.0
    k = round(share * n)
    least = kth_largest(scored, "sample_key", k) if k else float("inf")
    return scored.withColumn("kept", F.col("sample_key") >= least)


def selected(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, that the sample holds."""
    return without_rows(docs, select(docs, labels, share, seed, row_keys=True).filter("not kept"))
