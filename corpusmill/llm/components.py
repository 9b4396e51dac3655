"""Connected components of an undirected graph given by pairs of ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

LOCAL_EDGES = 500_000


def _local(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of (a, b), with the smallest neighbour or self of a."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for every id of edges(a, b); component is the smallest id reachable.

    Up to local_edges pairs, counted first, are solved in the driver; more by alternating
    large-star and small-star steps, each written to the shared folder.
    """
    spark = edges.sparkSession
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    n = edges.count()
    if n <= local_edges:
        got = edges.toArrow()
        ids, label = _local(got.column("a").to_numpy(), got.column("b").to_numpy())
        return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(label, pa.int64())}))
    state = None
    while True:
        large = _neighbours(edges).filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: each id's smaller neighbours and the id itself join the smallest of them
        small = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        pairs = small.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = cut(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("id"), "component").union(edges.select("a", F.col("a").alias("component")).distinct()).groupBy("id").agg(F.min("component").alias("component"))
