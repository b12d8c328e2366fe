"""Timelines of one block are solved in one call."""

from pyspark.sql import functions as F

from stridegrid.operators import maxplus
from stridegrid.plans.blocks import Line


def test_timelines_of_one_block_need_no_blocks(spark, monkeypatch):
    df = spark.range(40).select((F.col("id") % 4).alias("run_id"), F.floor(F.col("id") / 4).alias("at"), F.array(F.col("id") * 1.0).alias("x"), F.array(F.lit(0.0)).alias("y"), F.array(F.lit(0.5)).alias("g"))
    cost = lambda x, y, u, v: abs(u[:, None, :] - x[:, :, None]) * 1e-3
    monkeypatch.setattr(maxplus, "_best_of_blocks", None)  # would fail if called
    got = maxplus.best_paths(df, Line(("run_id",), "at", 10), "x", "y", "g", cost, "pick")
    assert sorted(tuple(r) for r in got.collect()) == [(run, at, 0) for run in range(4) for at in range(10)]
