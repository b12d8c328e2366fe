"""Gait: filtered joints, clinical angles, calibration, events, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridegrid.functions import pose as P
from stridegrid.functions.numbers import finite_or_null, frames_of, norm2, wrap_deg
from stridegrid.operators import events as E
from stridegrid.operators import windows as W
from stridegrid.operators.aggregates import cycle_curve, double_support, sample_sd
from stridegrid.operators.joins import toe_off_in_stride
from stridegrid.operators.recurrences import zero_phase_lowpass
from stridegrid.plans.blocks import RUNS, Line, neighbourhood
from stridegrid.plans.quantiles import exact_quantiles
from stridegrid.plans.session import cut

# Clinical thresholds.
MIN_STRIDE_S, MAX_STRIDE_S = 0.4, 3.0
MIN_EVENT_GAP_S = 0.25
IN_PLACE_SPEED_M_S = 0.10
STATIC_MAX_SPEED_M_S = 0.08
STATIC_MIN_RUN_S = 0.5
STATIC_MIN_TOTAL_S = 1.0
STATIC_MAX_LEAN_DEG = 25.0
STATIC_MAX_OFFSET_DEG = 45.0
ANGLES = ("hip_left", "hip_right", "knee_left", "knee_right", "ankle_left", "ankle_right")
SIGNAL_IDS = {
    "hip_left": "gait.hip.left.flexion_deg",
    "hip_right": "gait.hip.right.flexion_deg",
    "knee_left": "gait.knee.left.flexion_deg",
    "knee_right": "gait.knee.right.flexion_deg",
    "ankle_left": "gait.ankle.left.dorsiflexion_deg",
    "ankle_right": "gait.ankle.right.dorsiflexion_deg",
}
JOINTS = (5, 6, *P.SAGITTAL_JOINTS)


def filtered_joints(frames: DataFrame, fps: float, cutoff_hz: float = 6.0, line: Line = RUNS) -> DataFrame:
    """World points ``w<j>`` of the gait joints, all filtered in one pass."""
    df = P.with_points(frames, JOINTS, present=F.col("subject_present")).drop("joints")
    return zero_phase_lowpass(df, [f"w{j}_{a}" for j in JOINTS for a in "xyz"], fps, cutoff_hz, line)


def static_frames(
    df: DataFrame, fps: float, line: Line = RUNS, max_lean: float = STATIC_MAX_LEAN_DEG,
    min_run: int | None = None, min_total: int | None = None,
) -> DataFrame:
    """Flag quiet stance: both feet down, slow pelvis, upright trunk, long enough.

    ``df`` holds filtered ``w5 w6 w9 w10`` and the contacts ``left``, ``right``.
    """
    hips = P.midpoint(P.point(9), P.point(10))
    shoulders = P.midpoint(P.point(5), P.point(6))
    df = df.withColumns({**hips.named("_h"), "_lean": P.trunk_lean(hips, shoulders)})

    def exprs(w):
        x, y = F.col("_h_x"), F.col("_h_y")
        back = norm2(x - F.lag(x).over(w), y - F.lag(y).over(w)) * fps
        ahead = norm2(F.lead(x).over(w) - x, F.lead(y).over(w) - y) * fps
        return {"_speed": F.when(F.col(line.pos) == 0, ahead).otherwise(back)}

    df = neighbourhood(df, line, 1, exprs)
    quiet = (
        F.col("left") & F.col("right") & F.col("subject_present")
        & (F.col("_speed") <= STATIC_MAX_SPEED_M_S)
        & (F.col("_lean") <= max_lean)
    )
    least = frames_of(STATIC_MIN_RUN_S, fps, 1) if min_run is None else min_run
    total = frames_of(STATIC_MIN_TOTAL_S, fps) if min_total is None else min_total
    df = df.withColumn("_quiet", F.coalesce(quiet, F.lit(False)))
    df = W.in_long_islands(df, "_quiet", least, "_long", line)
    df = W.per_key(df, line, F.sum(F.col("_long").cast("int")).alias("_total"))
    enough = F.col("_total") >= total
    return df.withColumn("static", F.col("_long") & enough).drop(
        "_h_x", "_h_y", "_h_z", "_lean", "_speed", "_quiet", "_long", "_total"
    )


def neutral_offset(df: DataFrame, fps: float, line: Line = RUNS, angles=ANGLES) -> DataFrame:
    """Median of every angle over the static frames, per run, if trustworthy."""
    keys = list(line.keys)
    least = max(4, frames_of(0.2, fps))
    still = df.where("static").select(*keys, *angles)
    long = still.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("angle"), F.col(a).alias("v")) for a in angles])
        ).alias("s"),
    ).select(*keys, "s.angle", "s.v")
    long = cut(long)  # stance rows only
    med = exact_quantiles(long, [*keys, "angle"], "v", {"med": 0.5})
    n = long.groupBy(*keys, "angle").agg(F.count("v").alias("n"))
    wide = n.join(med, [*keys, "angle"], "left").groupBy(*keys).agg(
        F.min("n").alias("_least"),
        F.max(F.abs("med")).alias("_worst"),
        *[F.max(F.when(F.col("angle") == a, F.round("med", 3))).alias(f"offset_{a}") for a in angles],
    )
    counts = df.groupBy(*keys).agg(F.sum(F.col("static").cast("int")).alias("static_frames"))
    ok = (F.col("_least") >= least) & (F.col("_worst") <= STATIC_MAX_OFFSET_DEG)
    return counts.join(wide, keys, "left").select(
        *keys,
        F.coalesce("static_frames", F.lit(0)).alias("static_frames"),
        F.round(F.coalesce("static_frames", F.lit(0)) / max(fps, 1e-6), 3).alias("static_duration_s"),
        F.coalesce(ok, F.lit(False)).alias("applied"),
        *[F.when(ok, F.col(f"offset_{a}")).alias(f"offset_{a}") for a in angles],
    )


def apply_neutral(df: DataFrame, offsets: DataFrame, line: Line = RUNS, angles=ANGLES) -> DataFrame:
    """Angles relative to the subject's own stance."""
    cols = [f"offset_{a}" for a in angles]
    joined = df.join(offsets.select(*line.keys, *cols), list(line.keys), "left")
    return joined.withColumns(
        {
            a: F.when(F.col(f"offset_{a}").isNull(), F.col(a)).otherwise(
                wrap_deg(F.col(a) - F.col(f"offset_{a}"))
            )
            for a in angles
        }
    ).drop(*cols)


def gait_events(df: DataFrame, fps: float, line: Line = RUNS) -> DataFrame:
    """Heel strikes and toe-offs; strikes move to the lowest filtered heel height.

    ``df`` holds contacts ``left``/``right`` and filtered ``w17_z``/``w20_z``.
    """
    gap, reach = frames_of(MIN_EVENT_GAP_S, fps, 1), frames_of(0.12, fps, 1)
    out = None
    for side, heel in (("left", "w17_z"), ("right", "w20_z")):
        low = W.argmin_nearby(
            df.select(*line.keys, line.pos, side, "subject_present", heel), heel, reach, "_low", line
        )
        edges = W.contact_edges(low, side, "subject_present", line).withColumn("side", F.lit(side))
        edges = edges.select(*line.keys, line.pos, "side", "type", "_low")
        out = edges if out is None else out.unionByName(edges)
    keyed = Line((*line.keys, "side", "type"), line.pos, line.block)
    kept = E.spaced_events(out, gap, keyed, extra=("_low",))
    frame = F.when(F.col("type") == "heel_strike", F.col("_low")).otherwise(F.col(line.pos))
    return kept.select(
        *line.keys,
        "side",
        "type",
        frame.alias(line.pos),
        F.round(frame / max(fps, 1e-6), 4).alias("time_s"),
    )


def _at(df: DataFrame, keys: list[str], pos: str, target: str, cols: dict[str, Column]) -> DataFrame:
    return df.select(*keys, F.col(pos).alias(target), *[c.alias(n) for n, c in cols.items()])


def measured_strides(df: DataFrame, events: DataFrame, fps: float, line: Line = RUNS) -> DataFrame:
    """Strides of valid length with length, speed, stance and double support."""
    keys, pos = list(line.keys), line.pos
    st = E.strides(events, fps, line).where(
        F.col("duration_s").between(MIN_STRIDE_S, MAX_STRIDE_S)
    )
    heel = {"lx": F.col("w17_x"), "ly": F.col("w17_y"), "rx": F.col("w20_x"), "ry": F.col("w20_y")}
    for end in ("start", "end"):
        st = st.join(
            _at(df, keys, pos, f"{end}_frame", {f"_{end}_{n}": c for n, c in heel.items()}),
            [*keys, f"{end}_frame"],
        )
    by_side = lambda end, a: F.when(F.col("side") == "left", F.col(f"_{end}_l{a}")).otherwise(
        F.col(f"_{end}_r{a}")
    )
    length = norm2(by_side("end", "x") - by_side("start", "x"), by_side("end", "y") - by_side("start", "y"))
    st = st.withColumn("length_m", length).withColumn("speed_m_s", F.col("length_m") / F.col("duration_s"))
    st = st.select(*keys, "side", "start_frame", "end_frame", "duration_s", "length_m", "speed_m_s")
    st = toe_off_in_stride(st, events, line)
    contact = df.select(
        *keys, pos, (F.col("left") & F.col("subject_present")).alias("left"),
        (F.col("right") & F.col("subject_present")).alias("right"),
    )
    st = double_support(st, contact, line)
    span = F.col("end_frame") - F.col("start_frame")
    return st.withColumn("stance_pct", 100.0 * (F.col("toe_off") - F.col("start_frame")) / span)


def measured_steps(df: DataFrame, events: DataFrame, fps: float, line: Line = RUNS) -> DataFrame:
    """Alternating steps of valid length with their length."""
    keys, pos = list(line.keys), line.pos
    st = E.steps(events, fps, line).where(
        F.col("duration_s").between(MIN_STRIDE_S / 2, MAX_STRIDE_S)
    )
    heel = {"lx": F.col("w17_x"), "ly": F.col("w17_y"), "rx": F.col("w20_x"), "ry": F.col("w20_y")}
    for end in ("start", "end"):
        st = st.join(
            _at(df, keys, pos, f"{end}_frame", {f"_{end}_{n}": c for n, c in heel.items()}),
            [*keys, f"{end}_frame"],
        )
    pick = lambda side, end, a: F.when(F.col(side) == "left", F.col(f"_{end}_l{a}")).otherwise(
        F.col(f"_{end}_r{a}")
    )
    length = norm2(
        pick("end_side", "end", "x") - pick("side", "start", "x"),
        pick("end_side", "end", "y") - pick("side", "start", "y"),
    )
    return st.select(*keys, "side", "start_frame", "end_frame", "duration_s", length.alias("length_m"))


def spatiotemporal(
    runs: DataFrame, strides: DataFrame, steps: DataFrame, line: Line = RUNS
) -> DataFrame:
    """Cadence, times, lengths, speed and phase shares per run."""
    keys = list(line.keys)

    def stats(prefix: str, c: str) -> list[Column]:
        v = F.col(c)
        return [
            F.round(F.avg(v), 4).alias(f"{prefix}_mean"),
            F.round(sample_sd(v), 4).alias(f"{prefix}_sd"),
            F.count(v).alias(f"{prefix}_n"),
        ]

    a = strides.groupBy(*keys).agg(
        F.avg("speed_m_s").alias("_speed"),
        F.count(F.lit(1)).alias("_strides"),
        *stats("stride_time", "duration_s"),
        *stats("stride_length", "length_m"),
        *stats("walking_speed", "speed_m_s"),
        *stats("stance_pct", "stance_pct"),
        *stats("double_support_pct", "double_support_pct"),
    )
    b = steps.groupBy(*keys).agg(
        F.round(60.0 / F.avg("duration_s"), 2).alias("cadence_steps_per_min"),
        *stats("step_time", "duration_s"),
        *stats("step_length", "length_m"),
    )
    out = runs.select(*keys).distinct().join(a, keys, "left").join(b, keys, "left")
    walking = F.coalesce(F.col("_speed") >= IN_PLACE_SPEED_M_S, F.lit(False))
    counts = [c for c in out.columns if c.endswith("_n")]
    out = out.fillna(0, counts)
    for name in ("stride_length", "walking_speed", "step_length"):
        for part in ("mean", "sd", "n"):
            blank = F.lit(0) if part == "n" else F.lit(None)
            out = out.withColumn(
                f"{name}_{part}", F.when(walking, F.col(f"{name}_{part}")).otherwise(blank)
            )
    return out.withColumns(
        {
            "walking_detected": walking & (F.coalesce("_strides", F.lit(0)) >= 2),
            "swing_pct_mean": F.round(100.0 - F.col("stance_pct_mean"), 4),
        }
    ).drop("_speed", "_strides")


def resample_cycles(
    signals: DataFrame, strides: DataFrame, points: int = 101, line: Line = RUNS
) -> DataFrame:
    """Each signal over each stride at ``points`` even positions, 0 to 100 %.

    ``signals``: keys, position, signal_id, value. Strides of 0.4 to 3 s and at
    least 4 frames with 80 % of their values are used; gaps inside are bridged.
    """
    keys, pos = list(line.keys), line.pos
    span = F.col("end_frame") - F.col("start_frame")
    ok = strides.where(F.col("duration_s").between(MIN_STRIDE_S, MAX_STRIDE_S) & (span >= 4))
    rows = ok.select(
        *keys, "side", "start_frame", span.alias("_len"),
        F.explode(F.sequence("start_frame", "end_frame")).alias(pos),
    )
    joined = rows.join(signals, [*keys, pos]).withColumns(
        {"_o": F.col(pos) - F.col("start_frame"), "_v": finite_or_null(F.col("value"))}
    )
    cycle = Window.partitionBy(*keys, "side", "signal_id", "start_frame")
    order = cycle.orderBy("_o")
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col("_o").alias("o"), F.col("_v").alias("v")))
    a = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    share = F.count("_v").over(cycle) / (F.col("_len") + 1)
    filled = joined.select("*", a.alias("_a"), b.alias("_b"), share.alias("_share")).where("_share >= 0.8")
    t = (F.col("_o") - F.col("_a.o")) / (F.col("_b.o") - F.col("_a.o"))
    value = (
        F.when(F.col("_a").isNull(), F.col("_b.v"))
        .when(F.col("_b").isNull() | (F.col("_a.o") == F.col("_b.o")), F.col("_a.v"))
        .otherwise(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * t)
    )
    filled = filled.withColumn("_f", value)
    filled = filled.withColumn("_next", F.lead("_f").over(order))
    # sample positions that fall between this frame and the next
    last = points - 1
    lo = F.ceil(F.lit(last) * F.col("_o") / F.col("_len"))
    hi = F.when(F.col("_o") == F.col("_len"), F.lit(last)).otherwise(
        F.ceil(F.lit(last) * (F.col("_o") + 1) / F.col("_len")) - 1
    )
    sampled = filled.withColumns({"_lo": lo, "_hi": hi}).where("_hi >= _lo").withColumn(
        "pct", F.explode(F.sequence("_lo", "_hi"))
    )
    at = F.col("pct") * F.col("_len") / last - F.col("_o")
    return sampled.select(
        *keys,
        "side",
        "signal_id",
        F.col("start_frame").alias("cycle_id"),
        "pct",
        (F.col("_f") + (F.coalesce("_next", "_f") - F.col("_f")) * at).alias("value"),
    )


def cycle_curves(angles: DataFrame, strides: DataFrame, line: Line = RUNS) -> DataFrame:
    """Mean cycle of every clinical angle over the strides of its own side."""
    from stridegrid.operators.signals import to_long

    long = to_long(angles, SIGNAL_IDS, line)
    cycles = resample_cycles(long, strides, line=line)
    own = cycles.where(F.col("signal_id").contains(F.concat(F.lit("."), F.col("side"), F.lit("."))))
    return cycle_curve(own, [*line.keys, "side", "signal_id"])
