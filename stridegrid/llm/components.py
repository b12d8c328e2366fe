"""Connected components by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridegrid.llm.common import staged


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Tie the neighbours of each node to the least node among them and itself.

    Both ways (the large star) only larger neighbours are moved, else (the
    small star) smaller ones and the node itself. The least neighbour is a
    partial aggregate and joined back, so a hot node is no group in a task.
    """
    near = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if both_ways:
        near = near.union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    tied = near.join(least, "u")
    if both_ways:
        out = tied.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = tied.select(F.col("m").alias("a"), F.col("v").alias("b")).union(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    return out.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge (a, b); a component is its least node.

    Edges with a null or equal ends count for nothing. Each round is written
    to the shared folder and the rounds end when the edges no longer change.
    """
    edges = staged(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(
            edges["a"].isNotNull() & edges["b"].isNotNull() & (edges["a"] != edges["b"])
        ).distinct(),
        "edges",
    )
    before = _mark(edges)
    while before[0]:
        edges = staged(_stars(_stars(edges, True), False), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select("a", "a").distinct()
    )
