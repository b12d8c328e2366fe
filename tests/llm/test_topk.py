import math

import numpy as np
from pyspark.sql import functions as F

from stridegrid.llm.topk import _products, exact_topk


def brute(rows, k, every):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(set(out))


def test_matches_brute_force_with_ties_nulls_and_any_tiling(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(140)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (210, [1.0, 2.0]), (215, [0.5, 0.25]), (220, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")
    for sizes in ({}, {"query_rows": 7, "shard_rows": 11, "fan_in": 2}):
        got = exact_topk(table, F.col("vec_id") % 5 == 0, k=6, **sizes).collect()
        assert sorted(map(tuple, got)) == brute(rows, 6, 5)


def test_large_components_stay_exact():
    a = np.array([[2.0**40 + 1, 3.0]])
    assert _products(a, np.array([[2.0**20, 1.0]]))[0, 0] == (2**40 + 1) * 2**20 + 3


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert exact_topk(table, F.col("vec_id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")
    assert exact_topk(one, F.col("vec_id") % 5 == 0).count() == 0
