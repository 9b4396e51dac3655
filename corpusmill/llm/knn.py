"""Exact top-k by inner product: a Voronoi join.

Pivots (rows with the smallest hashes, about the square root of the rows and at most
MOST_PIVOTS) split the vectors into cells by nearest pivot. A cell's summary is its size,
its radius U, the widest angle to its pivot and the range of its norms. For a query q, no
vector of the cell with pivot p scores above <q, p> + |q| U, nor above what the angles and
norms allow. The query's k-th best can't fall below its k-th best score with the pivots
themselves, which are vectors of the table, nor below the k best lower bounds of cells;
cells whose upper bound is lower are unnecessary. Queries are grouped by pivots of their
own; a group's necessary cells are those of its members, and only their vectors are sent to
it. Small cells share a block and large ones are split, so that blocks hold about BLOCK
vectors and groups at most GROUP queries; a query goes only to the blocks of necessary
cells, and each returns its k best for each query, and these are merged.

Where vectors point everywhere alike, in many dimensions, such bounds exclude next to
nothing, and the join compares all; `needed` tells what a query needs.

Components become floor(scale * x), which doubles hold exactly; sums that doubles don't hold
are computed in integers of any length for all vectors that rounding might bring among the
best. Vectors that are null, empty, or hold null or non-finite components take no part, nor
do rows with a null id. Vectors of different lengths don't meet. A row never finds rows with
its own id; equal scores go to the smaller id; scores beyond 64 bits are ranked exactly and
shown as the nearest 64-bit number. Rows that repeat an id and a vector are found once, and
different vectors of one id count by the best of their scores. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import cut

K, SCALE, MOST_PIVOTS, GROUP, BLOCK = 5, 256, 2048, 16_384, 65_536
_RESULT = "query_id long, vec_id long, score decimal(38,0), wide string"


def integers(vectors: DataFrame, id_column: str, column: str, scale: int) -> DataFrame:
    """(vec_id, dim, v): usable vectors, packed as float32 where that holds all components exactly, else as float64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat = lists.flatten().cast(pa.float64())
            size = np.array(lists.value_lengths().fill_null(0))
            end = np.cumsum(size)
            x = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
            count = lambda test: (n := np.concatenate([[0], np.cumsum(test)]))[end] - n[end - size]
            ok = (size > 0) & (count(~np.isfinite(x)) == 0) & b.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                narrow = count(~(x.astype(np.float32) == x)) == 0
            for some, kind in ((ok & narrow, np.float32), (ok & ~narrow, np.float64)):
                if some.any():
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(some)), pa.array(size[some].astype(np.int32)), tk.pack(x[np.repeat(some, size)].astype(kind), np.concatenate([[0], np.cumsum(size[some])]))], names=["vec_id", "dim", "v"])

    source = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    return source.mapInArrow(run, "vec_id long, dim int, v binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    data, off = tk.buffers(column)
    wide = np.diff(off) == 8 * dim
    out = np.empty((len(wide), dim))
    inside = np.repeat(wide, np.diff(off))
    out[wide] = np.frombuffer(data[inside].tobytes(), np.float64).reshape(-1, dim)
    out[~wide] = np.frombuffer(data[~inside].tobytes(), np.float32).reshape(-1, dim)
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


def _angles(dot: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between vectors of norms a and b; a right angle for none."""
    both = a * b
    return np.arccos(np.clip(np.divide(dot, both, out=np.zeros_like(dot), where=both > 0), -1, 1))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (pivots**2).sum(1)
    at = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        at[i : i + 4096] = (square - 2 * x[i : i + 4096] @ pivots.T).argmin(1)
    return at, _norms(x - pivots[at])


def _pivots(rows: DataFrame, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n).select("v", "vec_id").toArrow()
    return _matrix(got.column("v").combine_chunks(), dim), got.column("vec_id").to_numpy()


def best(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The k best (query, id, score) of each query; x_id ascends."""
    ids, found, scores = [], [], []
    step = max(1, 2_000_000 // max(1, len(x)))
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    for i in range(0, len(q), step):
        part = q[i : i + step]
        s = part @ x.T
        own = q_id[i : i + step, None] == x_id
        s[own] = -np.inf
        error = np.zeros((len(s), 1)) if top < 2**53 else (2.0**-50 * q.shape[1] * (np.abs(part) @ np.abs(x).T)).max(1, keepdims=True)
        line = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else np.full((len(s), 1), -np.inf)
        row, at = np.nonzero((s >= line - 2 * error) & ~own)
        if top < 2**53:
            score = s[row, at]
            order = np.lexsort((at, -score, row))
            row, at, value = row[order], at[order], list(map(int, score[order].tolist()))
        else:
            exact = [sum(int(a) * int(b) for a, b in zip(part[r].tolist(), x[c].tolist(), strict=True)) for r, c in zip(row.tolist(), at.tolist(), strict=True)]
            order = sorted(range(len(row)), key=lambda j: (row[j], -exact[j], at[j]))
            row, at, value = row[order], at[order], [exact[j] for j in order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        ids.append(q_id[i + row[keep]])
        found.append(x_id[at[keep]])
        scores += [v for v, y in zip(value, keep.tolist(), strict=True) if y]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *ids]), np.concatenate([empty, *found]), scores


class Cells:
    """Summaries of the cells, and what a query needs of them."""

    def __init__(self, summary: pa.Table, pivots: np.ndarray, pivot_ids: np.ndarray, block: int = BLOCK) -> None:
        t = summary.sort_by("cell")
        self.cell, self.size = t.column("cell").to_numpy(), t.column("n").to_numpy()
        self.radius, self.angle, self.low, self.high = (t.column(c).to_numpy() for c in ("u", "angle", "low", "high"))
        self.pivots, self.ids = pivots, pivot_ids
        # cells share a block until it is full; one beyond the size of a block is split
        split = np.maximum(1, -(-self.size // block))
        base, held, at = [], 0, -1
        for n, k in zip(self.size.tolist(), split.tolist(), strict=True):
            if at < 0 or k > 1 or held + n > block:
                at, held = at + 1, 0
            base.append(at)
            at, held = at + k - 1, held + n if k == 1 else block
        self.base, self.split = np.array(base), split

    def needed(self, q: np.ndarray, q_id: np.ndarray, k: int) -> np.ndarray:
        """Which cells may hold one of the k best of each query."""
        norm, scores = _norms(q)[:, None], q @ self.pivots.T
        p = self.pivots[self.cell]
        middle, far = scores[:, self.cell], _norms(p)
        slack = 1e-9 * norm * (far + self.radius) + 1e-6
        reach = norm * self.radius + slack
        turn = np.cos(np.maximum(0, _angles(middle, norm, far) - self.angle - 1e-7))
        upper = np.minimum(middle + reach, norm * np.where(turn >= 0, self.high, self.low) * turn + slack)
        # k best lower bounds of cells; one more than k, since the query itself may be among them
        low, order = middle - reach, np.argsort(reach - middle, axis=1)
        enough = np.cumsum(self.size[order], axis=1) > k
        spot, rows = enough.argmax(1), np.arange(len(q))
        floor = np.where(enough.any(1), low[rows, order[rows, spot]], -np.inf)
        # the k-th best pivot, of pivots with ids of their own
        _, once = np.unique(self.ids, return_index=True)
        others = np.where(q_id[:, None] == self.ids[once], -np.inf, scores[:, once])
        if others.shape[1] >= k:
            floor = np.maximum(floor, np.partition(others, -k, axis=1)[:, -k] - slack.max(1))
        return upper >= floor[:, None]


def _join(rows: DataFrame, queries: DataFrame, dim: int, k: int, group: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    n, n_queries = rows.count(), queries.count()
    if not n_queries:
        return spark.createDataFrame([], _RESULT)
    pivots, pivot_ids = _pivots(rows, dim, int(min(MOST_PIVOTS, max(1, n**0.5))))
    sent = spark.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dim)
            cell, far = _nearest(x, sent.value)
            p, norm = sent.value[cell], _norms(x)
            angle = _angles((x * p).sum(1), norm, _norms(p))
            angle[(norm == 0) | (_norms(p) == 0)] = np.pi
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(angle), pa.array(norm)], names=["vec_id", "v", "cell", "far", "angle", "norm"])

    cells = cut(rows.select("vec_id", "v").mapInArrow(assign, "vec_id long, v binary, cell int, far double, angle double, norm double"))
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("u"), F.max("angle").alias("angle"), F.min("norm").alias("low"), F.max("norm").alias("high")).toArrow()  # a row a pivot
    known = Cells(summary, pivots, pivot_ids, block)
    own, _ = _pivots(queries, dim, max(1, min(MOST_PIVOTS, n_queries // group + 1)))
    told = spark.sparkContext.broadcast((known, own))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The group of each query, and the cells it needs as bits."""
        for b in batches:
            q = _matrix(b.column("v"), dim)
            near, _ = _nearest(q, told.value[1])
            need = told.value[0].needed(q, b.column("vec_id").to_numpy(), k)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array([np.packbits(x).tobytes() for x in need], pa.binary())], names=["vec_id", "v", "grp", "need"])

    bounded = cut(queries.select("vec_id", "v").mapInArrow(bound, "vec_id long, v binary, grp int, need binary"))
    sizes = bounded.groupBy("grp").agg(F.count("*").alias("members"))  # at most MOST_PIVOTS rows
    bounded = bounded.join(F.broadcast(sizes), "grp").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("members") / group)).cast("int"))

    def union(t: pa.Table) -> pa.Table:
        need = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("need").to_pylist()])
        at = np.flatnonzero(np.unpackbits(need)[: len(known.cell)])
        return pa.table({"grp": pa.array([t.column("grp")[0].as_py()] * len(at), pa.int32()), "part": pa.array([t.column("part")[0].as_py()] * len(at), pa.int32()), "cell": pa.array(known.cell[at]), "base": pa.array(known.base[at].astype(np.int32)), "split": pa.array(known.split[at].astype(np.int32))})

    needed = cut(bounded.select("grp", "part", "need").distinct().groupBy("grp", "part").applyInArrow(union, "grp int, part int, cell int, base int, split int"))
    blocks = needed.select("grp", "part", F.explode(F.sequence("base", F.col("base") + F.col("split") - 1)).alias("block")).distinct()
    left = bounded.select("grp", "part", "vec_id", "v").join(blocks, ["grp", "part"])
    right = cells.select("vec_id", "v", "cell").join(needed, "cell").select("grp", "part", "vec_id", "v", (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("split"))).cast("int").alias("block"))

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        q, v, score = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if a.num_rows and b.num_rows:
            b = b.sort_by("vec_id")
            q, v, score = best(_matrix(a.column("v").combine_chunks(), dim), a.column("vec_id").to_numpy(), _matrix(b.column("v").combine_chunks(), dim), b.column("vec_id").to_numpy(), k)
        # beyond 38 digits as text; such scores are few
        fits = [abs(s) < 10**38 for s in score]
        return pa.table({"query_id": pa.array(q), "vec_id": pa.array(v), "score": pa.array([s if f else None for s, f in zip(score, fits, strict=True)], pa.decimal128(38, 0)), "wide": pa.array([None if f else str(s) for s, f in zip(score, fits, strict=True)], pa.string())})

    keys = ("grp", "part", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, _RESULT)


def top_k(vectors: DataFrame, is_query: str, k: int = K, scale: int = SCALE, id_column: str = "vec_id", column: str = "embedding", group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best; is_query is a SQL condition on vec_id."""
    rows = cut(integers(vectors, id_column, column, scale).distinct())
    dims = [r.dim for r in rows.select("dim").distinct().collect()]  # lengths of vectors
    found = vectors.sparkSession.createDataFrame([], _RESULT)
    for dim in sorted(dims):
        same = rows.filter(F.col("dim") == dim)
        found = found.unionByName(_join(same, same.filter(is_query), dim, k, group, block))
    # an order of numbers of any length: sign, number of digits, digits
    digits = F.regexp_replace("wide", "^-", "")
    minus = F.col("wide").startswith("-")
    size = F.coalesce(F.when(minus, -F.length(digits)).otherwise(F.length(digits)), F.lit(0))
    key = F.struct(size.alias("size"), F.coalesce(F.when(minus, F.translate(digits, "0123456789", "9876543210")).otherwise(digits), F.lit("")).alias("digits"), F.coalesce("score", F.lit(0)).cast("decimal(38,0)").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    ranked = found.withColumn("key", key).groupBy("query_id", "vec_id").agg(F.max("key").alias("key")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    most = (1 << 63) - 1
    near = F.when(F.col("key.size") > 0, F.lit(most)).when(F.col("key.size") < 0, F.lit(-most - 1)).otherwise(F.least(F.greatest(F.col("key.score"), F.lit(-most - 1)), F.lit(most)).cast("long"))
    return ranked.select("query_id", "rank", "vec_id", near.alias("score"))
