"""Tokens as rows, and filters that drop paragraphs.

A paragraph starts at a token with PARAGRAPH_START, and at the first token. A text that
loses all its tokens, or had none, is dropped. Filters decide per text on its own token
array, so they need no shuffle; they run over flat Arrow columns, since array slices in the
JVM copy the whole array each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fits_broadcast, is_accented, small_side
from ..schema import PARAGRAPH_START, PUNCT, SENTENCE_START, UNRECOGNIZED


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def token_rows(texts: DataFrame) -> DataFrame:
    """text_id, tok_idx, para_idx, sent_idx and the token's fields."""
    rows = texts.select("text_id", F.posexplode("tokens").alias("tok_idx", "t")).select("text_id", "tok_idx", "t.*")
    w = Window.partitionBy("text_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, 0)
    start = lambda bit: F.sum(F.when(has(F.col("flags"), bit) | (F.col("tok_idx") == 0), 1).otherwise(0)).over(w)
    return rows.withColumn("para_idx", start(PARAGRAPH_START) - 1).withColumn("sent_idx", start(SENTENCE_START | PARAGRAPH_START) - 1)


def slices(b: pa.RecordBatch, size: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """b in slices of rows whose sizes come to `most` at the most, or of one row."""
    end, i = np.cumsum(size), 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, "right")))
        yield b.slice(i, j - i)
        i = j


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


class Flat:
    """The tokens of a batch of texts as flat columns, with the row and paragraph (or other unit) of each."""

    def __init__(self, b: pa.RecordBatch, starts: int = PARAGRAPH_START) -> None:
        lists = b.column("tokens")
        self.size = pc.fill_null(lists.value_lengths(), 0).to_numpy().astype(np.int64)
        self.tokens = lists.flatten()
        self.flags = pc.fill_null(self.tokens.field("flags"), 0).to_numpy()
        self.form = self.tokens.field("form")
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        begin = (self.flags & starts) != 0
        begin[(np.cumsum(self.size) - self.size)[self.size > 0]] = True
        self.unit = np.cumsum(begin) - 1
        self.first = np.flatnonzero(begin)
        self.word = (self.flags & PUNCT) == 0

    @property
    def place(self) -> np.ndarray:
        """The number of each unit in its text."""
        row = self.row[self.first]
        return np.arange(len(row)) - np.searchsorted(row, row)

    def count(self, test: np.ndarray) -> np.ndarray:
        return np.bincount(self.unit[test], minlength=len(self.first))

    def accented(self) -> np.ndarray:
        return self.word & pc.fill_null(pc.greater(pc.binary_length(self.form), pc.utf8_length(self.form)), False).to_numpy(zero_copy_only=False)


def keep_paragraphs(texts: DataFrame, judge: Callable[[Flat, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """texts with the paragraphs that judge(flat, batch) keeps; empty ones go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = Flat(b)
            keep = judge(flat, b)[flat.unit] if len(flat.first) else np.zeros(0, bool)
            size = np.bincount(flat.row[keep], minlength=b.num_rows)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat.tokens.filter(pa.array(keep)))
            at = b.schema.get_field_index("tokens")
            cells = [tokens if k == at else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cells, names=b.schema.names).filter(pa.array(size > 0))

    return texts.mapInArrow(run, texts.schema)


def per_unit(texts: DataFrame, starts: int, kind: str, make: Callable[[Flat], dict[str, pa.Array]]) -> DataFrame:
    """text_id, unit and what make(flat) tells of each paragraph, or sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = Flat(b, starts)
            yield pa.RecordBatch.from_pydict({"text_id": b.column("text_id").take(pa.array(flat.row[flat.first])), "unit": pa.array(flat.place.astype(np.int32))} | make(flat))

    return texts.select("text_id", "tokens").mapInArrow(run, f"text_id string, unit int, {kind}")


def forms_of(flat: Flat, which: np.ndarray) -> pa.Array:
    """The forms of each unit's tokens for which a test holds."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(flat.count(which))]), pa.int32()), flat.form.filter(pa.array(which)))


def filter_unaccented(texts: DataFrame, min_percent: int = 10, reverse: bool = False) -> DataFrame:
    """Drops paragraphs in which at most min_percent of the words hold accents."""
    return keep_paragraphs(texts, lambda t, _: (100 * t.count(t.accented()) > min_percent * t.count(t.word)) != reverse)


def missing_accents(words: DataFrame, listed: DataFrame, *keys: str) -> DataFrame:
    """keys, bad, good of words(keys, word): how many words are among listed(word), and how many hold accents."""
    found = words.join(small_side(listed.select(F.lower("word").alias("word"), F.lit(1).alias("hit")).distinct()), "word", "left")
    return found.groupBy(*keys).agg(F.count("hit").alias("bad"), F.count_if(is_accented(F.col("word"))).alias("good"))


def filter_missing_accents(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """Drops paragraphs with two or more words of listed(word), if these outnumber accented words.

    A list of up to BROADCAST_BYTES goes to all workers as a set, so that no text is moved;
    a longer one is joined.
    """
    known = listed.select(F.lower("word").alias("word")).distinct()
    if not fits_broadcast(known):
        return filter_missing_accents_joined(texts, listed)
    kept = texts.sparkSession.sparkContext.broadcast(frozenset(r.word for r in known.collect()))  # measured just before

    def fine(t: Flat, b: pa.RecordBatch) -> np.ndarray:
        low = b.column("__low").flatten().dictionary_encode(null_encoding="encode")
        words = kept.value
        hit = np.array([w is not None and w in words for w in low.dictionary.to_pylist()], bool)
        accented = np.array(pc.fill_null(pc.greater(pc.binary_length(low.dictionary), pc.utf8_length(low.dictionary)), False).to_numpy(zero_copy_only=False), bool)
        at = low.indices.to_numpy()
        bad, good = t.count(t.word & hit[at]), t.count(t.word & accented[at])
        return (bad < 2) | (good >= bad)

    lowered = texts.withColumn("__low", F.transform("tokens", lambda t: F.lower(t["form"])))
    return keep_paragraphs(lowered, fine).drop("__low")


def filter_missing_accents_joined(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """filter_missing_accents() for a list of any length."""
    words = per_unit(texts, PARAGRAPH_START, "words array<string>", lambda t: {"words": forms_of(t, t.word)})
    rows = words.select("text_id", "unit", F.explode("words").alias("word")).withColumn("word", F.lower("word"))
    bad = missing_accents(rows, listed, "text_id", "unit").filter("bad >= 2 and good < bad")
    gone = bad.groupBy("text_id").agg(F.collect_set("unit").alias("__gone"))  # at most the paragraphs of a text
    marked = texts.join(gone, "text_id", "left")

    def fine(t: Flat, b: pa.RecordBatch) -> np.ndarray:
        lists = b.column("__gone")
        row = np.repeat(np.arange(b.num_rows), pc.fill_null(lists.value_lengths(), 0).to_numpy())
        first = np.searchsorted(t.row[t.first], row)  # a text that lost a paragraph has one
        keep = np.ones(len(t.first), bool)
        keep[first + lists.flatten().to_numpy()] = False
        return keep

    return keep_paragraphs(marked, fine).drop("__gone")


def filter_unrecognized(texts: DataFrame, max_percent: int = 10, reverse: bool = False) -> DataFrame:
    """Drops paragraphs with two or more unknown words that are over max_percent of its words."""

    def fine(t: Flat, _: pa.RecordBatch) -> np.ndarray:
        bad = t.count(t.word & ((t.flags & UNRECOGNIZED) != 0))
        return ~((bad >= 2) & (100 * bad > max_percent * t.count(t.word))) != reverse

    return keep_paragraphs(texts, fine)


def language_passes(code: Column, allow: list[str] | None, deny: list[str] | None) -> Column:
    ok = F.lit(True)
    if allow:
        ok = ok & code.isin(allow)
    if deny:
        ok = ok & ~code.isin(deny)
    return ok


def filter_language(texts: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """One code judges the whole text; several judge paragraph by paragraph; none passes.

    The language list keeps the codes of the surviving paragraphs.
    """
    codes = F.coalesce(F.col("language"), F.array().cast("array<string>"))
    ok = lambda c: F.coalesce(language_passes(c, allow, deny), F.lit(False))
    out = texts.withColumn("__ok", F.transform(codes, ok)).filter((F.size(codes) != 1) | ok(F.get(codes, F.lit(0))))

    def passes(t: Flat, b: pa.RecordBatch) -> np.ndarray:
        lists = b.column("__ok")
        size = pc.fill_null(lists.value_lengths(), 0).to_numpy()
        row, flat = t.row[t.first], np.append(lists.flatten().to_numpy(zero_copy_only=False), False)
        at = (np.cumsum(size) - size)[row] + t.place
        return (size[row] < 2) | ((t.place < size[row]) & flat[np.minimum(at, len(flat) - 1)])

    many = F.size("__ok") > 1
    judged = keep_paragraphs(out.filter(many), passes).withColumn("language", F.filter("language", ok))
    return out.filter(~many).withColumn("language", codes).unionByName(judged).drop("__ok")


def delete_words(texts: DataFrame, drop) -> DataFrame:
    """Drops tokens for which drop(token, index) holds."""
    return texts.withColumn("tokens", F.filter("tokens", lambda t, i: ~drop(t, i)))


def joined(tokens: Column) -> Column:
    """The text of a token array: a space after each token that doesn't say otherwise."""
    return F.rtrim(F.aggregate(tokens, F.lit(""), lambda s, t: F.concat(s, t["form"], F.when(has(t["flags"], 4), "").otherwise(" "))))
