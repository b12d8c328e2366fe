"""Blocked operators agree with one pass over the whole timeline."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridegrid.operators import recurrences as R
from stridegrid.operators import windows as W
from stridegrid.operators.display import anchor_trajectory
from stridegrid.operators.joins import cheapest_pairs
from stridegrid.plans import quantiles as Q
from stridegrid.plans.blocks import Line, affine_recurrence, dense_position, running, stateful_rows

SMALL, WHOLE = Line(block=7), Line(block=100_000)


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("run_id", "frame_index").select(*cols).collect()]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    parts = []
    for run, n in ((1, 61), (2, 20), (3, 1)):
        v = rng.normal(size=n)
        v[rng.random(n) < 0.25] = np.nan
        parts.append(pd.DataFrame({"run_id": run, "frame_index": range(n), "v": v}))
    df = spark.createDataFrame(pd.concat(parts)).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df.repartition(3, "v")


def same(spark_rows_a, spark_rows_b, tol=1e-12):
    assert len(spark_rows_a) == len(spark_rows_b)
    for a, b in zip(spark_rows_a, spark_rows_b):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=tol, abs_tol=tol), (a, b)
            else:
                assert x == y, (a, b)


def test_scans_do_not_depend_on_the_block_size(series):
    def run(line):
        out = running(
            series, line, s=("sum", F.col("v")), sb=("sum_before", F.col("v")), l=("last", F.col("v")),
            p=("prev", F.col("v")), n=("next", F.col("v")), a=("after", F.col("v")), m=("max_before", F.col("v")),
        )
        return rows(out, "run_id", "frame_index", "s", "sb", "l", "p", "n", "a", "m")

    same(run(SMALL), run(WHOLE), 1e-9)


@pytest.mark.parametrize(
    "op",
    [
        lambda d, l: W.rolling_mean(d, 9, l, out="v"),
        lambda d, l: W.linear_gap_fill(d, l, out="v"),
        lambda d, l: W.edge_padded_mean(d.withColumn("v", F.coalesce("v", F.lit(0.0))), 19, l, out="v"),
        lambda d, l: W.argmin_nearby(d, "v", 9, "out", l),
        lambda d, l: W.carry_forward(d, 0.0, l, out="v"),
        lambda d, l: R.ema(d, "v", 0.35, "out", l),
        lambda d, l: R.one_euro(d, 30.0, {"out": ("v", 1.0, 0.3)}, l),
        lambda d, l: R.zero_phase_lowpass(d.withColumn("out", F.col("v")), ["out"], 30.0, 6.0, l),
        lambda d, l: W.unwrap_axial(d, "v", "out", l),
    ],
)
def test_operators_do_not_depend_on_the_block_size(series, op):
    cols = ("run_id", "frame_index", "out")
    same(rows(op(series, SMALL), *cols), rows(op(series, WHOLE), *cols), 1e-9)


def test_state_that_never_forgets_is_repaired(series):
    """A plain count has no memory limit; warm-up guesses are all wrong."""

    def step(state, pdf):
        n = 0.0 if state is None else float(state[0])
        out = pdf[["run_id", "frame_index"]].copy()
        out["c"] = [n + i + 1 for i in range(len(pdf))]
        return out, np.array([n + len(pdf)])

    out = stateful_rows(series, SMALL, step, [T.StructField("c", T.DoubleType())], warmup=3)
    assert all(c == i + 1 for _, i, c in rows(out, "run_id", "frame_index", "c"))


def test_affine_recurrence_matches_a_loop(series):
    df = series.withColumn("b", F.coalesce("v", F.lit(0.5)))
    out = affine_recurrence(df, SMALL, y=(F.lit(0.9), F.col("b")))
    y = 0.0
    for run, i, b, got in rows(out, "run_id", "frame_index", "b", "y"):
        y = (0.0 if i == 0 else y) * 0.9 + b
        assert math.isclose(got, y, rel_tol=1e-9)


def test_lowpass_has_unit_gain_and_half_gain_at_cutoff(spark):
    n, fps = 600, 60.0
    t = np.arange(n) / fps
    df = spark.createDataFrame(
        pd.DataFrame({"run_id": 1, "frame_index": range(n), "c": np.ones(n), "s": np.sin(2 * np.pi * 6 * t)})
    )
    out = R.zero_phase_lowpass(df, ["c", "s"], fps, 6.0, Line(block=200)).toPandas().sort_values("frame_index")
    assert np.allclose(out["c"].astype(float), 1.0, atol=1e-9)
    mid = out["s"].astype(float).to_numpy()[150:450]
    assert abs(mid.std() / np.sin(2 * np.pi * 6 * t)[150:450].std() - 0.5) < 0.01


def test_gap_rows_stay_missing_and_short_runs_pass(spark):
    v = np.sin(np.arange(300) / 9.0)
    v[100:120] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"run_id": 1, "frame_index": range(300), "v": v}))
    df = df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    out = R.zero_phase_lowpass(df, ["v"], 60.0).toPandas().sort_values("frame_index")
    missing = out["v"].isna().to_numpy()
    assert missing[100:120].all() and missing.sum() == 20


def test_clamped_anchor_matches_free_anchor_below_the_limit(spark):
    df = spark.createDataFrame(
        pd.DataFrame(
            {
                "run_id": 1, "frame_index": range(40), "support": ["left"] * 20 + ["right"] * 20,
                "support_x": np.linspace(0, 0.3, 40), "support_y": 0.0, "root_x": 0.0, "root_y": 0.0,
            }
        )
    )
    free = rows(anchor_trajectory(df, SMALL, 1e9), "run_id", "frame_index", "anchored_x")
    held = rows(anchor_trajectory(df, SMALL, 0.1), "run_id", "frame_index", "anchored_x")
    same(free[:10], held[:10], 1e-9)
    assert max(abs(x) for _, _, x in held) <= 0.1 + 1e-9 < max(abs(x) for _, _, x in free)


def test_quantiles_of_few_values_match_numpy(spark):
    rng = np.random.default_rng(7)
    sets = {n: rng.integers(0, 9, n).astype(float) for n in range(1, 40)}
    pdf = pd.DataFrame([(n, v) for n, x in sets.items() for v in x], columns=["k", "v"])
    qs = {"a": 0.0, "b": 0.1, "c": 0.3, "d": 0.5, "e": 0.95, "f": 1.0}
    for r in Q.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", qs).collect():
        assert np.allclose([r[x] for x in qs], np.quantile(sets[r.k], list(qs.values())), atol=1e-12)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    big = np.concatenate([rng.normal(size=30_000), np.zeros(20_000), rng.normal(size=10_000) * 50])
    pdf = pd.DataFrame({"k": 1, "v": big})
    df = spark.createDataFrame(pdf).repartition(4)
    got = Q.exact_quantiles(df, ["k"], "v", {"a": 0.12, "b": 0.5, "c": 0.88}).first()
    want = np.quantile(big, [0.12, 0.5, 0.88])
    assert np.allclose([got.a, got.b, got.c], want, atol=1e-12)
    low = Q.exact_quantiles(df, ["k"], "v", {"f": 0.1}, floor_rank=True).first().f
    assert low == np.sort(big)[int(len(big) * 0.1)]


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(1, 5, size=2)
        c = rng.normal(size=(n, m)).round(2)
        i, j = cheapest_pairs(c)
        assert len(set(i)) == len(i) == len(set(j)) == min(n, m)
        a = c if n <= m else c.T
        best = min(
            sum(a[r, p[r]] for r in range(a.shape[0]))
            for p in itertools.permutations(range(a.shape[1]), a.shape[0])
        )
        assert abs(c[i, j].sum() - best) < 1e-9


def test_dense_position_numbers_across_buckets(spark):
    df = spark.createDataFrame([(1, float(i % 50), i) for i in range(200)], "run_id int, t double, id int")
    out = dense_position(df, ["run_id"], ["t", "id"], F.floor(F.col("t") / 7))
    got = [tuple(r) for r in out.orderBy("frame_index").select("t", "id", "frame_index").collect()]
    want = sorted((float(i % 50), i) for i in range(200))
    assert got == [(t, i, k) for k, (t, i) in enumerate(want)]
