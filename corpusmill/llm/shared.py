"""Places for intermediate tables, and small helpers on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import small_batches


_RECORDERS: list[list[str]] = []


@contextmanager
def recorded(made: list[str]) -> Iterator[None]:
    """Enters the folders that work_folder() gives in the meantime into a list."""
    _RECORDERS.append(made)
    try:
        yield
    finally:
        _RECORDERS.remove(made)


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; on a cluster that names none this fails."""
    path = storage.work_folder(spark)
    for made in _RECORDERS:
        made.append(path)
    return path


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a written table: its lineage ends here and it survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = folder or work_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table has."""
    return df.select(*[F.col(f"`{n}`") for n in names])


BROADCAST_IDS = 500_000
ROW_KEY = ("doc_id", "__k1", "__k2")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with two hashes of the text, which with doc_id tell rows (but for exact repeats) apart."""
    return docs.withColumn("__k1", F.xxhash64("text")).withColumn("__k2", F.xxhash64(F.lit(17), "text"))


def on_key(left: DataFrame, *names: str) -> Column:
    """Equality of ROW_KEY of left with the named columns; nulls are equal."""
    return reduce(lambda x, y: x & y, (left[k].eqNullSafe(F.col(n)) for k, n in zip(ROW_KEY, names, strict=True)))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose ROW_KEY is in gone; up to BROADCAST_IDS keys, counted first, are broadcast."""
    gone = cut(gone.select(*ROW_KEY).distinct().toDF("__g0", "__g1", "__g2"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    rows = keyed(docs)
    return rows.join(gone, on_key(rows, "__g0", "__g1", "__g2"), "left_anti").drop("__k1", "__k2")
