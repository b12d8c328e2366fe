"""Evenly spread samples, scan grids and anchor densification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegrid.functions.boxes import Box
from stridegrid.plans.blocks import RUNS, Line, dense_position, running
from stridegrid.plans.quantiles import exact_quantiles


def _spread_ranks(n: Column, k: Column) -> Column:
    """Positions of ``k`` rows spread evenly over ``n``."""
    steps = F.sequence(F.lit(0).cast("long"), F.least(n, k) - 1)
    even = F.transform(
        steps, lambda i: F.bround(i * (n - 1).cast("double") / (k - 1)).cast("long")
    )
    return (
        F.when(k <= 0, F.array().cast("array<long>"))
        .when(n <= k, steps)
        .when(k == 1, F.array(F.floor(n / 2)))
        .otherwise(F.array_distinct(even))
    )


def spread_pick(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, k: int | Column
) -> DataFrame:
    """Up to ``k`` rows per key spread evenly along ``order``, ends included."""
    ranked = dense_position(df, keys, order, bucket, "_i")
    kcol = F.lit(k) if isinstance(k, int) else k
    sized = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(kcol).cast("long").alias("_k")
    )
    wanted = sized.where("_k > 0").select(
        *keys, F.explode(_spread_ranks(F.col("_n"), F.col("_k"))).alias("_i")
    )
    return ranked.join(wanted, [*keys, "_i"], "left_semi").drop("_i")


def scan_times(
    ranges: DataFrame, keys: list[str], budget: int, step: float = 0.0,
    preferred: DataFrame | None = None, ends: DataFrame | None = None,
) -> DataFrame:
    """Times to probe: the preferred ones, else a grid over the kept ranges.

    ``ends``: keys, end_sec of the video; a range without end reaches to it. A
    range without end of a key that has none there is an error.
    """
    known = F.lit(None).cast("double")
    if ends is not None:
        last = ends.groupBy(*keys).agg(F.max("end_sec").cast("double").alias("_last"))
        ranges, known = ranges.join(last, keys, "left"), F.col("_last")
    unknown = F.raise_error("a range without end, and the end of its video is not known").cast("double")
    end = F.coalesce(F.col("end_sec"), known, F.when(F.col("start_sec").isNotNull(), unknown))
    ranges = ranges.select(*keys, "start_sec", end.alias("end_sec"))
    total = ranges.groupBy(*keys).agg(
        F.sum(F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))).alias("_kept")
    )
    pitch = F.lit(float(step)) if step > 0 else F.greatest(F.lit(1.0), F.col("_kept") / max(1, budget))
    grid = ranges.join(total, keys).withColumn("_step", pitch)
    last = F.ceil((F.col("end_sec") - F.col("start_sec")) / F.col("_step"))
    grid = grid.where("end_sec > start_sec").select(
        *keys, "start_sec", "end_sec", "_step", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_j")
    )
    at = F.col("start_sec") + F.col("_j") * F.col("_step")
    grid = grid.where(at < F.col("end_sec")).select(*keys, F.bround(at, 3).alias("t")).distinct()
    thinned = spread_pick(grid, keys, ["t"], F.floor(F.col("t") / 4096), budget)
    if preferred is None:
        return thinned
    asked = preferred.select(*keys, F.bround(F.greatest(F.lit(0.0), F.col("t")), 3).alias("t")).distinct()
    if budget > 0:
        nth = dense_position(asked, keys, ["t"], F.floor(F.col("t") / 4096), "_i")
        asked = nth.where(F.col("_i") < budget).drop("_i")
    return asked.unionByName(thinned.join(asked, keys, "left_anti"))


def sample_results(
    df: DataFrame, keys: list[str], hit: str, order: list[str], bucket: Column, k: int
) -> DataFrame:
    """Spread over the hits, topped up with spread misses."""
    hits = df.groupBy(*keys).agg(F.sum(F.col(hit).cast("int")).alias("_hits"))
    room = df.join(hits, keys).withColumn(
        "_room", F.when(F.col(hit), F.lit(k)).otherwise(F.greatest(F.lit(0), F.lit(k) - F.col("_hits")))
    )
    return spread_pick(room, [*keys, hit], order, bucket, F.col("_room")).drop("_hits", "_room")


def densify_anchors(
    anchors: DataFrame, width: float, height: float, max_gap_factor: int = 3, line: Line = RUNS
) -> DataFrame:
    """Fill short gaps between anchor boxes by linear interpolation."""
    keys, pos = list(line.keys), line.pos
    corners = ["x1", "y1", "x2", "y2"]
    here = F.struct(F.col(pos).alias("f"), *[F.col(c).cast("double").alias(c) for c in corners])
    paired = running(anchors.select(*keys, pos, *corners), line, _next=("after", here))
    gaps = paired.withColumn("_gap", (F.col("_next.f") - F.col(pos)).cast("double"))
    stride = exact_quantiles(gaps, keys, "_gap", {"_mid": 0.5})
    gaps = gaps.join(stride, keys, "left")
    most = F.greatest(
        F.lit(2.0), max_gap_factor * F.greatest(F.lit(1.0), F.floor(F.coalesce("_mid", F.lit(1.0))))
    )
    fill = (F.col("_gap") > 1) & (F.col("_gap") <= most)
    offsets = F.when(fill, F.sequence(F.lit(0).cast("long"), F.col("_gap").cast("long") - 1)).otherwise(
        F.array(F.lit(0).cast("long"))
    )
    out = gaps.withColumn("_k", F.explode(offsets))
    t = F.col("_k") / F.col("_gap")
    a = Box.of()
    b = Box(*[F.col(f"_next.{c}") for c in corners])
    mixed = a.lerp(b, t).clip_inside(width, height)
    picked = [
        F.when(F.col("_k") == 0, p).otherwise(m).alias(c)
        for c, p, m in zip(corners, a.parts, mixed.parts)
    ]
    return out.select(*keys, (F.col(pos) + F.col("_k")).alias(pos), *picked)
