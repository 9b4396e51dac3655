"""From raw documents to token ids, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but
the last return the columns of documents. Extra columns stay, whatever their names (but for
those that begin with two underscores, which the stages use).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, decontaminate, near_dedup, quality
from corpusmill.llm.queries import tokenizer_path
from corpusmill.llm.shared import cut, drop_folder, recorded, table
from corpusmill.llm.substring_dedup import without_repeats


_LEFT: list[str] = []


def stage(f: Callable) -> Callable:
    """Deletes what earlier stages wrote on their way: their results are in a table by now."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LEFT:
            drop_folder(spark, _LEFT.pop())
        with recorded(_LEFT):
            return f(spark, docs, sf_dir)

    return run


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the importance sample rejects go; rows without n-grams or labels weigh 0 and are judged like others, exact repeats of a row alike; an empty table stays empty."""
    return quality.selected(docs, table(spark, sf_dir, "labels"))


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays, one of equals; rows without doc_id or words stay, and so do unrelated texts under a doc_id of which a copy goes."""
    return near_dedup.one_of_each(docs)


@stage
def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller doc_id has go; all rows stay, those without doc_id or words as they are, and rows that share a doc_id don't count against each other."""
    return without_repeats(docs)


@stage
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of the benchmark go; null and empty texts hold none, and an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded texts, one row a row; a null text has no ids."""
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(docs, path), path)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicate removal", one_of_each),
    ("substring deduplication", no_repeated_passages),
    ("benchmark decontamination", no_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: Gumbel noise and hashed n-grams of the first stage have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
