"""Annotated tokens: features, short tags, plug-in taggers and parsers, exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import small_side
from ..schema import TITLECASE, UNRECOGNIZED
from .paragraphs import has

KINDS = {"clanky": "article", "tvorivost": "blog", "diskuse": "discussion"}


def short_tag(pos: Column) -> Column:
    """The kind, and the case or, where there is none, the detail."""
    case = F.substring(pos, 5, 1)
    return F.concat(F.substring(pos, 1, 1), F.when((case != "-") & (case != ""), case).otherwise(F.substring(pos, 2, 1)))


def tagger_features(form: Column) -> Column:
    """Prefixes and suffixes of up to four characters, and whether there are digits, capitals and dashes."""
    n = F.length(form)
    return F.struct(
        *[F.substring(form, 1, k).alias(f"prefix{k}") for k in range(1, 5)],
        *[F.substring(form, F.greatest(n - k + 1, F.lit(1)), F.lit(k)).alias(f"suffix{k}") for k in range(1, 5)],
        form.rlike(r"\p{N}").alias("num"),
        form.rlike(r"\p{Lu}").alias("cap"),
        F.contains(form, F.lit("-")).alias("dash"),
    )


def following_verb(tokens: Column, at: Column | int) -> Column:
    """The first verb after a place in a token array: its lemma, or its form where there is none; null without one."""
    rest = F.slice(tokens, F.lit(at) + 2, F.greatest(F.size(tokens) - F.lit(at) - 1, F.lit(0)))
    verb = F.get(F.filter(rest, lambda t: F.coalesce(t["pos"].startswith("V"), F.lit(False))), F.lit(0))
    return F.coalesce(verb["lemma"], verb["form"])


def _per_sentence(texts: DataFrame, work: Callable[[list[dict]], list[dict]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                tokens, out, begin = r["tokens"] or [], [], 0
                for i in range(1, len(tokens) + 1):
                    if i == len(tokens) or tokens[i]["flags"] & 3:
                        out += work(tokens[begin:i])
                        begin = i
                r["tokens"] = out
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return texts.mapInArrow(run, texts.schema)


def tag(texts: DataFrame, tagger: Callable[[list[str]], list[tuple[str, str, bool]]]) -> DataFrame:
    """Lemmas and tags by a plug-in: tagger(forms of a sentence) gives (lemma, tag, guessed)."""

    def work(sentence: list[dict]) -> list[dict]:
        found = tagger([t["form"] for t in sentence])
        return [t | {"lemma": lemma, "pos": pos, "flags": t["flags"] | (UNRECOGNIZED if guessed else 0)} for t, (lemma, pos, guessed) in zip(sentence, found, strict=True)]

    return _per_sentence(texts, work)


def parse(texts: DataFrame, parser: Callable[[list[str], list[str]], list[tuple[int, str]] | None]) -> DataFrame:
    """Heads and relations by a plug-in: parser(forms, tags) gives (head, deprel); a failure gives 0 and ExD."""

    def work(sentence: list[dict]) -> list[dict]:
        try:
            found = parser([t["form"] for t in sentence], [t["pos"] or "" for t in sentence])
        except Exception:  # noqa: BLE001 - a sentence that can't be parsed is no failure of the corpus
            found = None
        if found is None or len(found) != len(sentence):
            found = [(0, "ExD")] * len(sentence)
        return [t | {"head": head, "deprel": rel} for t, (head, rel) in zip(sentence, found, strict=True)]

    return _per_sentence(texts, work)


def export(texts: DataFrame) -> DataFrame:
    """Tokens without flags, and each language once."""
    return texts.withColumn("language", F.array_distinct("language")).withColumn("tokens", F.transform("tokens", lambda t: F.struct(t["form"].alias("form"), t["lemma"].alias("lemma"), t["pos"].alias("pos"), t["head"].alias("head"), t["deprel"].alias("deprel"))))


def add_attributes(texts: DataFrame, times: DataFrame, addresses: DataFrame) -> DataFrame:
    """subtype, server, url, time and lang of texts by id `data/<kind>-<server>/...`.

    times(server, time), with server '*' as the default; addresses(text_id, url).
    """
    kind, server = F.regexp_extract("text_id", r"^data/([^/-]+)", 1), F.regexp_extract("text_id", r"^data/[^/-]+-([^/]+)/", 1)
    subtype = F.coalesce(*[F.when(kind == k, v) for k, v in KINDS.items()], kind)
    default = times.filter("server = '*'").select(F.col("time").alias("default_time")).limit(1)
    out = texts.withColumn("subtype", subtype).withColumn("server", server)
    out = out.join(small_side(times.filter("server <> '*'")), "server", "left").join(small_side(addresses), "text_id", "left").join(F.broadcast(default), F.lit(True), "left")  # default is one row
    return out.withColumn("time", F.coalesce("time", "default_time")).drop("default_time").withColumn("lang", F.get("language", F.lit(0)))


def with_family(tokens: DataFrame) -> DataFrame:
    """tokens(doc, sent, tok, form, lemma, pos, head) with lower form, short lemma, the parent's and the children's."""
    rows = tokens.withColumn("low", F.lower("form")).withColumn("short", F.regexp_extract("lemma", r"^(.[^-_`]*)", 1))
    parent = rows.select("doc", "sent", (F.col("tok") + 1).alias("head"), F.col("low").alias("parent_form"), F.col("short").alias("parent_lemma"), F.col("pos").alias("parent_pos"))
    below = rows.filter("head > 0").groupBy("doc", "sent", (F.col("head") - 1).alias("tok")).agg(*[F.array_sort(F.collect_set(c)).alias(f"child_{n}s") for c, n in (("low", "form"), ("short", "lemma"), ("pos", "pos"))])
    out = rows.join(parent, ["doc", "sent", "head"], "left").join(below, ["doc", "sent", "tok"], "left")
    for c in ("parent_form", "parent_lemma", "parent_pos"):
        out = out.withColumn(c, F.coalesce(c, F.lit("#root")))
    return out


class Trees:
    """The tokens of a batch of whole texts as flat columns, with the row, place in the sentence and parent of each; -1 for none.

    tokens have sent and head, from 1 in the sentence; a sentence's tokens follow each other.
    """

    def __init__(self, b: pa.RecordBatch) -> None:
        lists = b.column("tokens")
        size = pc.fill_null(lists.value_lengths(), 0).to_numpy().astype(np.int64)
        flat = lists.flatten()
        self.fields = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
        self.row = np.repeat(np.arange(len(size)), size)
        sent, head = (pc.fill_null(self.fields[c], 0).to_numpy().astype(np.int64) for c in ("sent", "head"))
        new = np.ones(len(sent), bool)
        new[1:] = (sent[1:] != sent[:-1]) | (self.row[1:] != self.row[:-1])
        start = np.flatnonzero(new)
        unit = np.cumsum(new) - 1
        length = np.diff(np.append(start, len(sent)))
        first = start[unit]
        self.place = np.arange(len(sent)) - first
        self.parent = np.where((head > 0) & (head <= length[unit]), first + head - 1, -1)

    def of_parent(self, column: pa.Array, default: str) -> pa.Array:
        return pc.fill_null(column.take(pa.array(self.parent, mask=self.parent < 0)), default)

    def of_children(self, column: pa.Array) -> pa.Array:
        """The children's distinct values in order, or null for a token without children."""
        coded = column.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
        most, rank = max(len(order), 1), np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        has_value = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        some = np.bincount(self.parent[self.parent >= 0], minlength=len(self.parent)) > 0
        child = (self.parent >= 0) & has_value
        pairs = np.unique(self.parent[child] * most + rank[pc.fill_null(coded.indices, 0).to_numpy()[child]])
        ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // most, minlength=len(self.parent)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(order[pairs % most])), mask=pa.array(~some))


def family_in_texts(texts: DataFrame) -> DataFrame:
    """with_family() of texts(doc, tokens) that have all tokens of a doc in one array: nothing is shuffled.

    Gives doc, sent, tok, parent_form, parent_pos and child_forms.
    """
    rows = texts.select("doc", F.transform("tokens", lambda t: F.struct(t["sent"].alias("sent"), F.lower(t["form"]).alias("low"), t["pos"].alias("pos"), t["head"].alias("head"))).alias("tokens"))
    schema = T.StructType([rows.schema["doc"], *[T.StructField(n, T.IntegerType()) for n in ("sent", "tok")], *[T.StructField(n, T.StringType()) for n in ("parent_form", "parent_pos")], T.StructField("child_forms", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Trees(b)
            low, pos = t.fields["low"], t.fields["pos"]
            cells = [b.column("doc").take(pa.array(t.row)), t.fields["sent"], pa.array(t.place.astype(np.int32)), t.of_parent(low, "#root"), t.of_parent(pos, "#root"), t.of_children(low)]
            yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return rows.mapInArrow(run, schema)


def titlecased(flags: Column) -> Column:
    return has(flags, TITLECASE)
