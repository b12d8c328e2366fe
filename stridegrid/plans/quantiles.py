"""Exact quantiles per key without holding a key's values in one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 10_000


def ranked_slices(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Sorted distinct values around each quantile with the ranks ``[_from, _to)`` they take.

    A mergeable sketch bounds every quantile from both sides; values outside the
    bounds collapse to one row a side before the shuffle, which keeps the one
    value next to the bounds. So the sort per key sees about ``2 / accuracy`` of
    its distinct values. The ranks are exact.
    """
    slack = 2.0 / _ACCURACY
    qcol = F.array(*[F.lit(float(q)) for q in qs])
    v = F.col(value)
    data = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    lows = F.array(*[F.lit(max(0.0, q - slack)) for q in qs])
    highs = F.array(*[F.lit(min(1.0, q + slack)) for q in qs])
    bounds = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", lows, _ACCURACY).alias("_lo"),
        F.percentile_approx("_v", highs, _ACCURACY).alias("_hi"),
    )
    bounds = bounds.select(
        *keys, "_n", F.posexplode(F.arrays_zip(qcol.alias("q"), "_lo", "_hi"))
    ).select(*keys, "_n", F.col("col.q").alias("q"), F.col("col._lo").alias("_lo"), F.col("col._hi").alias("_hi"))
    joined = data.join(bounds, keys) if keys else data.crossJoin(F.broadcast(bounds))
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    counted = (
        joined.withColumn("_side", side)
        .withColumn("_x", F.when(F.col("_side") == 0, F.col("_v")))
        .groupBy(*keys, "q", "_side", "_x")
        .agg(
            F.count(F.lit(1)).alias("_c"),
            F.first("_n").alias("_n"),
            F.min("_v").alias("_least"),
            F.max("_v").alias("_most"),
        )
    )
    upto = (
        Window.partitionBy(*keys, "q")
        .orderBy("_side", "_x")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.withColumn("_cum", F.sum("_c").over(upto))
    below, above = F.col("_side") < 0, F.col("_side") > 0
    return ranked.select(
        *keys,
        "q",
        "_n",
        F.when(below, F.col("_most")).when(above, F.col("_least")).otherwise(F.col("_x")).alias("_x"),
        F.when(below, F.col("_cum") - 1).otherwise(F.col("_cum") - F.col("_c")).alias("_from"),
        F.when(above, F.col("_cum") - F.col("_c") + 1).otherwise(F.col("_cum")).alias("_to"),
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, qs: dict[str, float], floor_rank: bool = False
) -> DataFrame:
    """One row per key with a column per named quantile.

    Linear interpolation between the two nearest ranks, or with ``floor_rank``
    the element at index ``min(n - 1, floor(n * q))``.
    """
    ranked = ranked_slices(df, keys, value, sorted(set(qs.values())))
    if floor_rank:
        at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.col("q")))
        lo_at, frac, hi_at = at, F.lit(0.0), at
    else:
        at = (F.col("_n") - 1) * F.col("q")
        lo_at, hi_at, frac = F.floor(at), F.ceil(at), at - F.floor(at)

    def pick(rank: Column) -> Column:
        hit = (F.col("_from") <= rank) & (F.col("_to") > rank)
        return F.max(F.when(hit, F.col("_x")))

    per_q = ranked.groupBy(*keys, "q").agg(
        pick(lo_at).alias("_a"), pick(hi_at).alias("_b"), F.max(frac).alias("_f")
    )
    per_q = per_q.withColumn(
        "_r", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    )
    return per_q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == F.lit(float(q)), F.col("_r"))).alias(n) for n, q in qs.items()]
    )
