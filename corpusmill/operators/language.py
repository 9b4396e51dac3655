"""Language of texts or paragraphs from tables of frequent words."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import small_side
from ..schema import PUNCT
from .paragraphs import has, token_rows

def weights(table: DataFrame) -> DataFrame:
    """table(lang, word) to word, lang and evidence: 1 / number of the word's languages."""
    t = table.select("lang", F.lower("word").alias("word")).distinct()
    many = t.groupBy("word").agg(F.count("*").alias("langs"))
    return t.join(many, "word").select("word", "lang", "langs")


def detect(words: DataFrame, table: DataFrame, default: str, *keys: str) -> DataFrame:
    """keys, language of words(keys, word).

    The language with most evidence wins; the default one wins ties and where there is no
    evidence, then the first by code.
    """
    # 2520 is divisible by 1 to 10, so the evidence is exact for up to 10 languages
    counts = words.select(*keys, F.lower("word").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    hits = counts.join(small_side(weights(table)), "word").groupBy(*keys, "lang").agg(F.sum(F.col("n") * F.floor(F.lit(2520) / F.col("langs"))).alias("score"))
    best = hits.groupBy(*keys).agg(F.max("score").alias("score"))
    first = hits.join(best, [*keys, "score"]).groupBy(*keys).agg(F.max((F.col("lang") == default).cast("int")).alias("own"), F.min("lang").alias("first"))
    chosen = first.select(*keys, F.when(F.col("own") == 1, F.lit(default)).otherwise(F.col("first")).alias("language"))
    return words.select(*keys).distinct().join(chosen, list(keys), "left").select(*keys, F.coalesce("language", F.lit(default or "?")).alias("language"))


def detect_texts(texts: DataFrame, table: DataFrame, default: str, paragraph_level: bool = True) -> DataFrame:
    """texts with `language` from their tokens: one code, or one a paragraph."""
    rows = token_rows(texts).filter(~has(F.col("flags"), PUNCT)).select("text_id", F.col("para_idx") if paragraph_level else F.lit(0).alias("para_idx"), F.col("form").alias("word"))
    found = detect(rows, table, default, "text_id", "para_idx").groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "language"))), lambda x: x["language"]).alias("found"))
    return texts.join(found, "text_id", "left").withColumn("language", F.coalesce("found", F.array(F.lit(default or "?")))).drop("found").select(*texts.columns)


def detect_with(text: Column, detector: Callable[[str], list[tuple[str, int]]], least_percent: int = 20) -> Column:
    """Plug-in detection: the first of up to three guesses with enough of the text, else '?'."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: next((lang for lang, percent in detector(x or "")[:3] if percent >= least_percent), "?"))

    return run(text)


def train(words: DataFrame, most: int = 100_000) -> DataFrame:
    """lang, word, freq: the commonest words of each language in words(lang, word)."""
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= most)
    return ranked.join(F.broadcast(total), "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("freq"))  # a row a language
