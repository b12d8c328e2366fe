"""Time-series operators along a run; every shuffle is on (run, block)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegrid.functions.numbers import finite_or_null, frames_of, norm2
from stridegrid.plans.blocks import RUNS, Line, neighbourhood, running
from stridegrid.plans.quantiles import exact_quantiles
from stridegrid.plans.session import cut


def per_key(df: DataFrame, line: Line, *aggs: Column) -> DataFrame:
    """Attach aggregates of the whole run to each of its rows."""
    return df.join(df.groupBy(*line.keys).agg(*aggs), list(line.keys), "left")


def rolling_mean(df: DataFrame, window: int, line: Line = RUNS, **cols: str) -> DataFrame:
    """Centred mean over finite values, ``out=input``; null where none is finite."""
    pad = max(1, window) // 2
    return neighbourhood(
        df,
        line,
        pad,
        lambda w: {
            out: F.avg(finite_or_null(F.col(c))).over(w.rowsBetween(-pad, pad))
            for out, c in cols.items()
        },
    )


def smooth_xy(df: DataFrame, x: str, y: str, radius: int, line: Line = RUNS) -> DataFrame:
    """Centred mean of a path's X and Y, the raw value where nothing is finite."""
    out = rolling_mean(df, 2 * radius + 1, line, _mx=x, _my=y)
    return out.withColumns(
        {x: F.coalesce("_mx", F.col(x)), y: F.coalesce("_my", F.col(y))}
    ).drop("_mx", "_my")


def edge_padded_mean(df: DataFrame, window: int, line: Line = RUNS, **cols: str) -> DataFrame:
    """Centred mean with the first and last value repeated past the ends."""
    p = max(1, window) // 2
    if p == 0:
        return df.withColumns({out: F.col(c) for out, c in cols.items()})

    def exprs(w):
        span = w.rowsBetween(-p, p)
        rows = F.count(F.lit(1))
        lead_missing = p - rows.over(w.rowsBetween(-p, -1))
        tail_missing = p - rows.over(w.rowsBetween(1, p))
        out = {}
        for name, c in cols.items():
            total = (
                F.sum(c).over(span)
                + lead_missing * F.first(c).over(span)
                + tail_missing * F.last(c).over(span)
            )
            whole = F.count(c).over(span) == rows.over(span)
            out[name] = F.when(whole, total / (2 * p + 1))
        return out

    return neighbourhood(df, line, p, exprs)


def derivative(df: DataFrame, fps: float, line: Line = RUNS, **cols: str) -> DataFrame:
    """Backward difference per second; null on the first row and at gaps."""
    rate = max(fps, 1.0)
    return neighbourhood(
        df,
        line,
        1,
        lambda w: {out: (F.col(c) - F.lag(c).over(w)) * rate for out, c in cols.items()},
    )


def speed(df: DataFrame, fps: float, line: Line = RUNS, **paths: tuple[str, ...]) -> DataFrame:
    """Norm of the backward difference of a path per second, ``out=(x, y, ...)``."""
    rate = max(fps, 1.0)

    def exprs(w):
        out = {}
        for name, axes in paths.items():
            total = F.lit(0.0)
            for a in axes:
                d = F.col(a) - F.lag(a).over(w)
                total = total + d * d
            out[name] = F.sqrt(total) * rate
        return out

    return neighbourhood(df, line, 1, exprs)


def slip_speed(df: DataFrame, fps: float, line: Line = RUNS, **feet: tuple[str, str]) -> DataFrame:
    """Speed against the last known foot position, whatever the gap."""
    scans = {
        f"_p_{n}": ("prev", F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
        for n, (x, y) in feet.items()
    }
    out = running(df, line, **scans)
    for n, (x, y) in feet.items():
        before = F.col(f"_p_{n}")
        out = out.withColumn(
            n, norm2(F.col(x) - before["x"], F.col(y) - before["y"]) * max(fps, 1.0)
        )
    return out.drop(*scans)


def baseline_distance(df: DataFrame, line: Line = RUNS, **paths: tuple[str, str, str]) -> DataFrame:
    """Distance from the first valid point of the run."""
    aggs = []
    for n, axes in paths.items():
        pt = F.struct(F.col(line.pos).alias("p"), *[F.col(a).alias(c) for a, c in zip(axes, "xyz")])
        aggs.append(F.min(F.when(F.col(axes[0]).isNotNull(), pt)).alias(f"_b_{n}"))
    out = per_key(df, line, *aggs)
    for n, axes in paths.items():
        total = F.lit(0.0)
        for a, c in zip(axes, "xyz"):
            d = F.col(a) - F.col(f"_b_{n}")[c]
            total = total + d * d
        out = out.withColumn(n, F.sqrt(total))
    return out.drop(*[f"_b_{n}" for n in paths])


def carry_forward(df: DataFrame, default: float = 0.0, line: Line = RUNS, **cols: str) -> DataFrame:
    """Latest valid value at or before the row, else the default."""
    scans = {f"_l_{o}": ("last", finite_or_null(F.col(c))) for o, c in cols.items()}
    out = running(df, line, **scans)
    return out.withColumns(
        {o: F.coalesce(F.col(f"_l_{o}"), F.lit(default)) for o in cols}
    ).drop(*scans)


def linear_gap_fill(df: DataFrame, line: Line = RUNS, **cols: str) -> DataFrame:
    """Linear inside gaps, nearest value outside; ``out=input``."""
    scans = {}
    for o, c in cols.items():
        pt = F.when(
            finite_or_null(F.col(c)).isNotNull(),
            F.struct(F.col(line.pos).alias("p"), F.col(c).alias("v")),
        )
        scans[f"_l_{o}"] = ("last", pt)
        scans[f"_n_{o}"] = ("next", pt)
    out = running(df, line, **scans)
    for o in cols:
        a, b = F.col(f"_l_{o}"), F.col(f"_n_{o}")
        t = (F.col(line.pos) - a["p"]) / (b["p"] - a["p"])
        out = out.withColumn(
            o,
            F.when(a.isNull(), b["v"])
            .when(b.isNull() | (a["p"] == b["p"]), a["v"])
            .otherwise(a["v"] + (b["v"] - a["v"]) * t),
        )
    return out.drop(*scans)


def contact_edges(df: DataFrame, contact: str, present: str, line: Line = RUNS) -> DataFrame:
    """Rows where a contact begins (heel_strike) or ends (toe_off)."""
    on = F.coalesce(F.col(contact) & F.col(present), F.lit(False))
    out = neighbourhood(
        df.withColumn("_on", on), line, 1, lambda w: {"_was": F.lag("_on").over(w)}
    )
    kind = F.when(F.col("_on") & ~F.col("_was"), "heel_strike").when(
        ~F.col("_on") & F.col("_was"), "toe_off"
    )
    return out.withColumn("type", kind).where(F.col("type").isNotNull()).drop("_on", "_was")


def argmin_nearby(df: DataFrame, value: str, radius: int, out: str, line: Line = RUNS) -> DataFrame:
    """Position of the lowest value within ``radius`` rows, the first on a tie."""
    pair = F.when(
        finite_or_null(F.col(value)).isNotNull(), F.struct(F.col(value), F.col(line.pos).alias("p"))
    )
    return neighbourhood(
        df.withColumn("_vp", pair),
        line,
        radius,
        lambda w: {
            out: F.coalesce(F.min("_vp").over(w.rowsBetween(-radius, radius))["p"], F.col(line.pos))
        },
    ).drop("_vp")


def islands(df: DataFrame, flag: str, line: Line = RUNS) -> DataFrame:
    """Contiguous spans where ``flag`` holds: keys, start, end, length."""
    on = F.coalesce(F.col(flag), F.lit(False))
    marked = neighbourhood(
        df.select(*line.keys, line.pos, on.alias("_on")),
        line,
        1,
        lambda w: {"_starts": (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int")},
    )
    numbered = running(marked, line, _isle=("sum", F.col("_starts"))).where("_on")
    return (
        numbered.groupBy(*line.keys, "_isle")
        .agg(F.min(line.pos).alias("start"), F.max(line.pos).alias("end"))
        .withColumn("length", F.col("end") - F.col("start") + 1)
        .drop("_isle")
    )


def in_long_islands(df: DataFrame, flag: str, least: int, out: str, line: Line = RUNS) -> DataFrame:
    """Mark rows inside spans of at least ``least`` rows."""
    on = F.coalesce(F.col(flag), F.lit(False))
    pos = F.col(line.pos)
    ends = running(
        df, line,
        _off_before=("prev", F.when(~on, pos)),
        _off_after=("after", F.when(~on, pos)),
    )
    edge = df.groupBy(*line.keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    ends = ends.join(edge, list(line.keys))
    size = F.coalesce("_off_after", F.col("_hi") + 1) - F.coalesce("_off_before", F.col("_lo") - 1) - 1
    return ends.withColumn(out, on & (size >= least)).drop(
        "_off_before", "_off_after", "_lo", "_hi"
    )


def unwrap_axial(df: DataFrame, angle: str, out: str, line: Line = RUNS) -> DataFrame:
    """Continuous version of an axis angle (theta and theta + pi are equal)."""
    a = F.col(angle)
    scanned = running(df, line, _before=("prev", a))
    turn = _half_turn(a - F.col("_before"))
    scanned = scanned.withColumn("_turn", F.coalesce(turn, F.lit(0.0)))
    scanned = running(scanned, line, _sum=("sum", F.col("_turn")))
    first = F.min(F.when(a.isNotNull(), F.struct(F.col(line.pos), a.alias("v"))))
    scanned = per_key(scanned, line, first.alias("_first"))
    return scanned.withColumn(
        out, F.when(a.isNotNull(), F.col("_first")["v"] + F.col("_sum"))
    ).drop("_before", "_turn", "_sum", "_first")


def _half_turn(d: Column) -> Column:
    """Half of the doubled step wrapped into [-pi, pi]."""
    two = 2.0 * d
    return (two - 2 * math.pi * F.round(two / (2 * math.pi))) / 2.0


def yaw_rate(df: DataFrame, angle: str, fps: float, out: str, line: Line = RUNS) -> DataFrame:
    """Smoothed absolute turn rate of an axis angle in degrees per second."""
    rate = max(fps, 1.0) * 180.0 / math.pi
    turned = neighbourhood(
        df, line, 1,
        lambda w: {"_rate": F.abs(_half_turn(F.col(angle) - F.lag(angle).over(w))) * rate},
    )
    window = frames_of(0.20, max(fps, 1.0), 3)
    return rolling_mean(turned, window, line, **{out: "_rate"}).drop("_rate")


def foot_lift_candidates(
    df: DataFrame, x: str, y: str, z: str, fps: float, line: Line = RUNS
) -> DataFrame:
    """Local height peaks of a foot path that clear lift and motion thresholds."""
    rate = max(fps, 1.0)
    smooth = edge_padded_mean(
        df.select(*line.keys, line.pos, x, y, z),
        frames_of(0.08, rate, 3) | 1, line, _x=x, _y=y, _h=z,
    )
    reach = frames_of(0.18, rate, 1)

    def exprs(w):
        span = w.rowsBetween(-reach, reach)
        moved = norm2(
            F.last("_x").over(span) - F.first("_x").over(span),
            F.last("_y").over(span) - F.first("_y").over(span),
        )
        return {
            "_disp": moved,
            "_up": F.lag("_h").over(w),
            "_down": F.lead("_h").over(w),
        }

    moved = cut(neighbourhood(smooth, line, reach, exprs))
    keys = list(line.keys)
    heights = exact_quantiles(moved, keys, "_h", {"_q12": 0.12, "_q25": 0.25, "_q88": 0.88})
    moves = exact_quantiles(moved, keys, "_disp", {"_q65": 0.65})
    counts = moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    gates = heights.join(moves, keys).join(counts, keys)
    lift = lambda c: F.greatest(F.col(c) - F.col("_q12"), F.lit(0.0))
    return (
        moved.join(gates, keys)
        .withColumn("lift", lift("_h"))
        .where(
            (F.col("_n") >= 5)
            & (F.col("lift") >= F.greatest(F.lit(0.012), (F.col("_q88") - F.col("_q25")) * 0.35))
            & (F.col("_disp") >= F.greatest(F.lit(0.010), F.col("_q65") * 0.35))
            & (F.col("lift") >= lift("_up"))
            & (F.col("lift") >= lift("_down"))
            & F.col("_up").isNotNull()
            & F.col("_down").isNotNull()
        )
        .select(*keys, line.pos, "lift")
    )
