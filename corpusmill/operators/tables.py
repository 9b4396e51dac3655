"""Merging, splitting and ordering of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def update(original: DataFrame, updated: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Updated rows, the first of each key, and original rows that have none."""
    first = updated
    if order:
        first = updated.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
    return first.unionByName(original.join(updated.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def update_index(index: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge: seen values replace the index's, and new keys get zeros where nothing is known."""
    values = [c for c in index.columns if c not in keys]
    new = seen.select(*keys, *[F.col(c).alias(f"__{c}") for c in values if c in seen.columns])
    both = index.join(new, keys, "full_outer")
    return both.select(*keys, *[F.coalesce(*([F.col(f"__{c}")] if c in seen.columns else []), F.col(c), F.lit(0)).cast(index.schema[c].dataType).alias(c) for c in values])


def new_links(links: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Keys never seen, once each, as NEW_LINK."""
    return links.join(known.select(*keys), keys, "left_anti").dropDuplicates(keys).withColumn("path_status", F.lit("NEW_LINK"))


def prefix_to_status(rows: DataFrame, column: str, pattern: str = r"^(data/[^/]+/)") -> DataFrame:
    """status: a dense number for each prefix, in order of the prefixes.

    The distinct prefixes, and not the rows, are numbered, so no task holds all rows.
    """
    prefix = F.regexp_extract(F.col(column), pattern, 1)
    numbers = rows.select(prefix.alias("prefix")).distinct().withColumn("status", F.row_number().over(Window.orderBy("prefix")) - 1)
    return rows.withColumn("prefix", prefix).join(numbers, "prefix")


def write_split(rows: DataFrame, folder: str, column: str, most_rows: int = 0) -> None:
    """One folder for each value, in files of at most most_rows."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", most_rows).partitionBy(column).parquet(folder)


def write_sized(rows: DataFrame, folder: str, most_rows: int) -> None:
    rows.write.mode("overwrite").option("maxRecordsPerFile", most_rows).parquet(folder)


def concat(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def shuffled(rows: DataFrame, *keys: str, seed: int = 3434) -> DataFrame:
    """A fixed random order, and each row's place in it as `shuffle_key`."""
    return rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed), *keys)).orderBy("shuffle_key", *keys)


def fair_order(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`turn`: the first of each group, then the second of each, and so on."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def collated(rows: DataFrame, *columns: str, locale: str = "cs") -> DataFrame:
    """rows in the order of a language, as n-gram files have it: in Czech, `ch` comes after `h`."""
    return rows.orderBy(*[F.collate(F.col(c), locale) for c in columns], *columns)


def top(rows: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(k)


def dictionary(words: DataFrame, column: str = "word") -> DataFrame:
    """word, id: ids from 1, the commonest word first; 0 is free for the end of a document.

    Ids are dense: words are sorted over all partitions, and each partition's offset is the
    number of words in earlier ones.
    """
    counts = words.groupBy(F.col(column).alias("word")).agg(F.count("*").alias("n"))
    ranked = counts.repartitionByRange(F.desc("n"), F.asc("word")).sortWithinPartitions(F.desc("n"), F.asc("word")).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    ranked = cut(ranked)  # the two uses below must see the same partitions
    sizes = ranked.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    return ranked.join(F.broadcast(before), "part").select("word", (F.col("before") + F.col("at") + 1).alias("id"))  # a row a partition


def encode_words(words: DataFrame, ids: DataFrame, column: str = "word") -> DataFrame:
    return words.join(ids.withColumnRenamed("word", column), column, "left").withColumn("id", F.coalesce("id", F.lit(0)))


def decode_words(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "id", "left")


def resource_status(rows: DataFrame, type_id: int) -> DataFrame:
    return rows.withColumn("status", F.lit(type_id))


def routed(rows: DataFrame, *cases: tuple[Column, DataFrame | int]) -> DataFrame:
    """status by the first condition that holds, else 0."""
    out = F.lit(0)
    for condition, status in reversed(cases):
        out = F.when(condition, F.lit(status)).otherwise(out)
    return rows.withColumn("status", out)
