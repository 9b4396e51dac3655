"""Counts over corpora: words, languages, n-grams, trained word lists, collocations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.hashes import murmur3_all
from ..functions.text import unaccent
from ..schema import NUMERIC, PARAGRAPH_START, PUNCT, SENTENCE_START
from .annotate import Trees
from .paragraphs import forms_of, has, lengths, per_unit, slices


def observed(rows: DataFrame, name: str, **tests: Column) -> tuple[DataFrame, Observation]:
    """rows, and what an action on them counts on its way: items, and those for which each test holds."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("items"), *[F.count_if(t).alias(k) for k, t in tests.items()]), seen


def word_count(texts: DataFrame, *keys: str) -> DataFrame:
    """docs, paragraphs, sentences, words, tokens and annotation counts of tokenised texts."""
    t = F.col("tokens")
    n = lambda test: F.size(F.filter(t, test)).cast("long")
    given = lambda f: n(lambda x: x[f].isNotNull())
    per = texts.select(
        *keys,
        n(lambda x: has(x["flags"], PARAGRAPH_START)).alias("paragraphs"),
        n(lambda x: has(x["flags"], SENTENCE_START)).alias("sentences"),
        n(lambda x: ~has(x["flags"], PUNCT)).alias("words"),
        F.size(t).cast("long").alias("tokens"),
        *[given(f).alias(f"{f}s") for f in ("lemma", "pos", "head", "deprel")],
    )
    sums = [F.sum(c).alias(c) for c in ("paragraphs", "sentences", "words", "tokens", "lemmas", "poss", "heads", "deprels")]
    return per.groupBy(*keys).agg(F.count("*").alias("docs"), *sums)


def language_count(texts: DataFrame) -> DataFrame:
    """Words of each language, most first, with their percentage; texts without one count as '?'."""
    words = per_unit(texts, PARAGRAPH_START, "n long", lambda t: {"n": pa.array(t.count(t.word))})
    codes = texts.select("text_id", F.coalesce("language", F.array().cast("array<string>")).alias("language"))
    code = F.when(F.size("language") == 1, F.get("language", F.lit(0))).when(F.size("language") > 1, F.get("language", F.col("unit")))
    rows = words.join(codes, "text_id").select(F.coalesce(code, F.lit("?")).alias("lang"), "n")
    return with_percent(rows.groupBy("lang").agg(F.sum("n").alias("words")))


def with_percent(counts: DataFrame) -> DataFrame:
    """counts(lang, words), a row a language, with percent and display."""
    total = F.sum("words").over(Window.partitionBy())
    out = counts.withColumn("percent", F.round(100.0 * F.col("words") / total, 2))
    return out.orderBy(F.desc("words"), "lang")


def merge_language_counts(counts: DataFrame, listed: list[str]) -> DataFrame:
    """Sums counts(lang, words); languages that aren't listed are 'other'."""
    return with_percent(counts.groupBy(F.when(F.col("lang").isin(listed), F.col("lang")).otherwise("other").alias("lang")).agg(F.sum("words").alias("words")))


#: Words whose n-grams are counted at once.
GRAM_WORDS = 1 << 20
_PARTS = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("sizes", pa.binary()), ("grams", pa.binary()), ("counts", pa.binary())])


def _counted(forms: pa.Array, size: np.ndarray, most: int, least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each n and bucket of n-grams of sentences, which have size forms each: the n-grams, one after the other, their sizes and counts."""
    coded = forms.dictionary_encode()
    known = pa.concat_arrays([pa.array(["<S>", "</S>"]), coded.dictionary])
    hashed = murmur3_all(known).astype(np.uint64)
    end = np.cumsum(size + 2)
    form = np.full(end[-1], -1, np.int64)
    form[end - size - 2], form[end - 1] = 0, 1
    form[form < 0] = coded.indices.to_numpy() + 2
    ids, last, columns = form, np.repeat(end, size + 2), []
    for n in range(1, most + 1):
        key = ids[:-1] << 32 | form[n - 1 :] if n > 1 else form  # from numbers of the shorter n-grams
        at = np.flatnonzero(np.arange(len(key)) + n <= last[: len(key)])
        if not len(at):
            return
        if 1 < n < most:
            distinct, place, count = np.unique(key[at], return_inverse=True, return_counts=True)
            ids = np.zeros(len(key), np.int64)
            ids[at] = place
        else:
            distinct, count = np.unique(key[at], return_counts=True)
        columns = [c[distinct >> 32] for c in columns] + [distinct & 0xFFFFFFFF]
        if n >= least:
            h = np.zeros(len(distinct), np.uint64)
            for c in columns:
                h = h * np.uint64(0x9E3779B97F4A7C15) + hashed[c]
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            parts = [known.take(pa.array(c[order])) for c in columns]
            gram = pc.binary_join_element_wise(*parts, "\t") if n > 1 else parts[0]
            off = np.frombuffer(gram.buffers()[1], np.int32, len(gram) + 1, gram.offset * 4)
            bucket = bucket[order]
            rows = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            numbers = [pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer((rows * 4).astype(np.int32)), pa.py_buffer(x.astype(np.uint32))]) for x in (np.diff(off), count[order])]
            grams = pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer(off[rows]), gram.buffers()[2]])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[rows[:-1]].astype(np.int32)), pa.array(np.full(len(rows) - 1, n, np.int32)), numbers[0], grams, numbers[1]], schema=_PARTS)


def ngram_counts(sentences: DataFrame, most: int, column: str = "forms", least: int = 1) -> DataFrame:
    """n, gram (forms joined by tabs) and count, for n from least to most; sentences(forms array) are padded with <S> and </S>.

    GRAM_WORDS at a time are counted as numbers, and only their distinct n-grams become
    strings. These are shuffled before any are added up, since a task's distinct n-grams grow
    with it: packed, a row for each of 16 buckets a partition, whose n-grams a worker
    adds up at once. So more partitions make for less memory.
    """
    buckets = 16 * int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = GRAM_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: list[tuple[pa.Array, np.ndarray]] = []

        def put() -> Iterator[pa.RecordBatch]:
            forms, size = zip(*hold, strict=True)
            hold.clear()
            yield from _counted(pa.concat_arrays(forms), np.concatenate(size), most, least, buckets)

        held = 0
        for b in (x for b in batches for x in slices(b, lengths(b.column(0)), words)):
            lists = b.column(0).drop_null()
            if len(lists):
                hold.append((lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)))
                held += len(hold[-1][0]) + 2 * len(lists)
            if held >= words:
                yield from put()
                held = 0
        if hold:
            yield from put()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, parts in zip(b.column("n").to_pylist(), b.column("parts"), strict=True):
                cells = {x: b"".join(parts.values.field(x).to_pylist()) for x in ("sizes", "grams", "counts")}
                off = np.concatenate([[0], np.cumsum(np.frombuffer(cells["sizes"], np.uint32), dtype=np.int64)])
                coded = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(cells["grams"])]).dictionary_encode()
                count = np.bincount(coded.indices.to_numpy(), np.frombuffer(cells["counts"], np.uint32)).astype(np.int64)  # exact to 2 ** 53
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(count), n, np.int32)), coded.dictionary.cast(pa.string()), pa.array(count)], names=["n", "gram", "count"])

    found = sentences.select(column).mapInArrow(run, "bucket int, n int, sizes binary, grams binary, counts binary").repartition("bucket")
    parts = found.groupBy("bucket", "n").agg(F.collect_list(F.struct("sizes", "grams", "counts")).alias("parts"))
    return parts.select("n", "parts").mapInArrow(add, "n int, gram string, count long")


def merge_counts(*parts: DataFrame, keys: tuple[str, ...] = ("n", "gram")) -> DataFrame:
    """Sums counts of several files or batches."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("count").alias("count"))


def sentence_forms(texts: DataFrame) -> DataFrame:
    """One row a sentence: text_id, sent_idx, forms."""
    found = per_unit(texts, SENTENCE_START | PARAGRAPH_START, "forms array<string>", lambda t: {"forms": forms_of(t, np.ones(len(t.flags), bool))})
    return found.withColumnRenamed("unit", "sent_idx")


def learnable_words(texts: DataFrame) -> DataFrame:
    """Lower-cased words of tokenised texts, without punctuation and plain numbers."""
    rows = texts.select(F.explode("tokens").alias("t")).select("t.flags", F.lower("t.form").alias("word"))
    return rows.filter(~has(F.col("flags"), PUNCT) & ~(has(F.col("flags"), NUMERIC) & F.col("word").rlike(r"^[0-9]+$"))).select("word")


def word_table(words: DataFrame, most: int = 100_000) -> DataFrame:
    """The commonest words of words(word) with count and share of all."""
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("word", "n", (F.col("n") / F.col("total")).alias("freq")).orderBy(F.desc("n"), "word").limit(most)  # total is one row


def missing_accent_words(counts: DataFrame, most: int = 100_000, percent: int = 5) -> DataFrame:
    """Unaccented spellings that are almost never right.

    counts(word, n): for each accented word, its plain spelling, if that has at most
    `percent` of the accented word's count; the `most` commonest, each once.
    """
    accented = counts.select(F.col("word").alias("accented"), F.col("n").alias("n_accented"), unaccent(F.col("word")).alias("word")).filter("accented <> word")
    plain = counts.select("word", F.col("n").alias("n_plain"))
    ok = accented.join(plain, "word", "left").filter(100 * F.coalesce("n_plain", F.lit(0)) <= percent * F.col("n_accented"))
    return ok.groupBy("word").agg(F.max("n_accented").alias("n_accented")).orderBy(F.desc("n_accented"), "word").limit(most)


def collocations(tokens: DataFrame) -> DataFrame:
    """Pairs of a token and its parent, both ways.

    tokens(doc, sent, tok, lemma, pos, head, deprel), head from 1 and 0 for the root.
    Counts only tokens of kinds N, A, V, D whose parent is one, for Obj, Sb, Adv and Atr;
    returns key (lemma-kind), relation, other and the sorted positions.
    """
    kind = F.substring("pos", 1, 1)
    rows = tokens.withColumn("kind", kind).withColumn("key", F.concat_ws("-", "lemma", "kind"))
    parent = rows.filter(F.col("kind").isin("N", "A", "V", "D")).select("doc", "sent", (F.col("tok") + 1).alias("head"), F.col("key").alias("p_key"), F.col("lemma").alias("p_lemma"))
    pairs = rows.filter(F.col("kind").isin("N", "A", "V", "D")).join(parent, ["doc", "sent", "head"])
    pairs = pairs.withColumn("position", F.row_number().over(Window.partitionBy("doc").orderBy("sent", "tok")).cast("long")).filter(F.col("deprel").isin("Obj", "Sb", "Adv", "Atr"))
    down = pairs.select(F.col("key"), F.col("deprel").alias("relation"), F.col("p_lemma").alias("other"), "doc", "position")
    up = pairs.select(F.col("p_key").alias("key"), F.concat(F.lit("-"), "deprel").alias("relation"), F.col("lemma").alias("other"), "doc", "position")
    return down.union(up).groupBy("key", "relation", "other").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("doc", "position"))).alias("positions"))


KINDS, RELATIONS = ("N", "A", "V", "D"), ("Obj", "Sb", "Adv", "Atr")


def collocation_counts(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """key, relation, other and count of collocations(), of texts(doc, tokens) that have all tokens of a doc in one array, and of tokens of other docs.

    A batch counts pairs as numbers. Only distinct ones are shuffled, as one string of a letter
    for the relation (a capital one for a null), the length of the key, the key and the other.
    """
    field = lambda t, *names: [t[x].alias(x) for x in names]
    kind = lambda t: F.substring(t["pos"], 1, 1)
    rows = texts.select(F.transform("tokens", lambda t: F.struct(*field(t, "sent", "head", "lemma", "deprel"), kind(t).alias("kind"))).alias("tokens"))
    letters = "abcdefgh"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Trees(b)
            kind, relation = (pc.fill_null(pc.index_in(t.fields[c], pa.array(known)), -1).to_numpy().astype(np.int64) for c, known in (("kind", KINDS), ("deprel", RELATIONS)))
            child = np.flatnonzero((t.parent >= 0) & (kind >= 0) & (relation >= 0))
            child = child[kind[t.parent[child]] >= 0]
            parent, relation = t.parent[child], relation[child]
            lemma = t.fields["lemma"].dictionary_encode("encode")
            at, most = lemma.indices.to_numpy().astype(np.int64), max(len(lemma.dictionary), 1)
            pairs = np.concatenate([((at[child] * 4 + kind[child]) * most + at[parent]) * 8 + relation, ((at[parent] * 4 + kind[parent]) * most + at[child]) * 8 + 4 + relation])
            pairs, count = np.unique(pairs, return_counts=True)
            key, others = pairs // 8 // most, lemma.dictionary.take(pa.array(pairs // 8 % most))
            keys = pc.binary_join_element_wise(lemma.dictionary.take(pa.array(key // 4)), pa.array(KINDS).take(pa.array(key % 4)), "-", null_handling="skip")
            code = pa.array(list(letters + letters.upper())).take(pa.array(pairs % 8 + 8 * others.is_null().to_numpy(zero_copy_only=False)))
            pair = pc.binary_join_element_wise(code, pc.utf8_length(keys).cast(pa.string()), pa.scalar(":"), keys, pc.fill_null(others, ""), "")
            yield pa.RecordBatch.from_arrays([pair, pa.array(count)], names=["pair", "count"])

    names = F.array(*[F.lit(x + r) for x in ("", "-") for r in RELATIONS])
    letter = F.substring(F.lit(letters), F.array_position(names, F.col("relation")).cast("int"), F.lit(1))
    pair = F.concat(F.when(F.col("other").isNull(), F.upper(letter)).otherwise(letter), F.length("key").cast("string"), F.lit(":"), "key", F.coalesce("other", F.lit("")))
    rest = collocations(tokens).select(pair.alias("pair"), "count")
    found = rows.mapInArrow(run, "pair string, count long").union(rest).groupBy("pair").agg(F.sum("count").alias("count"))
    head = F.substring_index("pair", ":", 1)
    size, at = F.substring(head, 2, F.length(head)).cast("int"), F.length(head) + 2
    letter = F.substring("pair", 1, 1)
    other = F.when(F.lower(letter) == letter, F.substring("pair", at + size, F.length("pair")))
    return found.select(F.substring("pair", at, size).alias("key"), F.element_at(names, F.ascii(F.lower(letter)) - ord("a") + 1).alias("relation"), other.alias("other"), "count")


def merge_collocations(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key", "relation", "other").agg(F.sum("count").alias("count"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
