"""Exact top-k search: tiled matrix products, a partial selection per tile, a merge tree."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOP = "qb int, dim int, node int, query_id bigint, vec_id bigint, score bigint"
_FIELDS = [
    ("qb", pa.int32()),
    ("dim", pa.int32()),
    ("node", pa.int32()),
    ("query_id", pa.int64()),
    ("vec_id", pa.int64()),
    ("score", pa.int64()),
]


def integer_vector(vector: Column, scale: float = 64.0) -> Column:
    """Each component as floor(scale * x) of its double value; null where a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    return F.when(whole, F.transform(x, lambda v: F.floor(F.lit(scale) * v)))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    flat = table.column(name).combine_chunks()
    flat = flat.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1).astype(np.float64)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum reaches 2**53, else with whole numbers."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(vectors)), np.int64)
    most = np.abs(queries).sum(axis=1).max() * np.abs(vectors).max()
    if most < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    return (queries.astype(np.int64).astype(object) @ vectors.astype(np.int64).astype(object).T).astype(np.int64)


def _selected(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best allowed scores of each row, ties to the left column."""
    low = np.iinfo(np.int64).min
    scores = np.where(allowed, scores, low)
    if scores.shape[1] > k:
        edge = np.partition(scores, -k, axis=1)[:, -k][:, None]
        above = scores > edge
        tied = scores == edge
        keep = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        keep = np.ones(scores.shape, bool)
    return np.nonzero(keep & allowed)


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
    query_rows: int = 1024,
    shard_rows: int = 8192,
    fan_in: int = 8,
) -> DataFrame:
    """The k rows of the largest integer inner product for every row that ``is_query`` marks.

    Queries and rows are cut into blocks; each (query block, shard) tile is one
    matrix product that keeps k rows per query, and lists meet ``fan_in`` at a
    time in a tree, so a task never holds more than one tile or
    ``fan_in * query_rows * k`` rows. ``is_query`` is a condition on the key.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id. Vectors that are null or hold null or non-finite components, and
    rows without key, take no part. Vectors of different length are not
    compared. Rows that repeat a key are one candidate each, but none of them
    is a candidate of its own key. Other columns are not read.
    """
    rows = vectors.select(
        F.col(key).cast("bigint").alias("vec_id"),
        integer_vector(F.col(vector), scale).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / query_rows))
    rows = rows.select(
        F.size("vec").alias("dim"),
        "vec_id",
        "vec",
        "asks",
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("node"),
        F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("qb"),
    )
    upto = lambda m: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: i.cast("int"))
    asking = rows.where("asks").select("dim", "qb", F.explode(upto(shards)).alias("node"), "vec_id", "vec")
    held = rows.select(
        F.col("dim").alias("h_dim"),
        F.explode(upto(blocks)).alias("h_qb"),
        F.col("node").alias("h_node"),
        F.col("vec_id").alias("h_id"),
        F.col("vec").alias("h_vec"),
    )

    def tile(key: tuple, queries: pa.Table, shard: pa.Table) -> pa.Table:
        dim, qb, node = (x.as_py() for x in key)
        if not queries.num_rows or not shard.num_rows:
            return pa.table([pa.array([], t) for _, t in _FIELDS], names=[x for x, _ in _FIELDS])
        q, v = queries.column("vec_id").to_numpy(), shard.column("h_id").to_numpy()
        order = np.argsort(v, kind="stable")
        v = v[order]
        scores = _products(_matrix(queries, "vec"), _matrix(shard, "h_vec")[order])
        r, c = _selected(scores, q[:, None] != v[None, :], k)
        m = len(r)
        return pa.table(
            [
                pa.array(np.full(m, qb, np.int32)),
                pa.array(np.full(m, dim, np.int32)),
                pa.array(np.full(m, node, np.int32)),
                pa.array(q[r]),
                pa.array(v[c]),
                pa.array(scores[r, c]),
            ],
            names=[x for x, _ in _FIELDS],
        )

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("query_id", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
        q = table.column("query_id").to_numpy()
        first = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        return table.filter(pa.array(rank < k)).append_column("rank", pa.array(rank[rank < k].astype(np.int32) + 1))

    keys = ["dim", "qb", "node"]
    lists = asking.groupBy(*keys).cogroup(held.groupBy("h_dim", "h_qb", "h_node")).applyInArrow(tile, _TOP)
    names = [x for x, _ in _FIELDS]
    while True:
        shards = math.ceil(shards / fan_in)
        lists = lists.withColumn("node", (F.col("node") / fan_in).cast("int")).select(*names)
        lists = lists.groupBy(*keys).applyInArrow(merge, _TOP + ", rank int")
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
