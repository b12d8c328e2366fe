"""The per-run analysis: stabilised root, signals, gait and quality, for all runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridegrid.functions import pose as P
from stridegrid.functions.numbers import frames_of
from stridegrid.operators import events as E
from stridegrid.operators import gait as G
from stridegrid.operators import windows as W
from stridegrid.operators.aggregates import choose_trajectory, qa_summary
from stridegrid.operators.recurrences import support_stabilize
from stridegrid.operators.signals import to_long
from stridegrid.plans.blocks import RUNS, Line
from stridegrid.plans.session import cut

SIGNALS = {
    "stable_x": "root.stab.x",
    "stable_y": "root.stab.y",
    "root_z": "root.stab.z",
    "slip_left": "foot.left.slip_speed",
    "slip_right": "foot.right.slip_speed",
    "root_speed": "root.xy_speed",
    "ankle_activity": "gait.ankle_relative_speed",
    "yaw_rate": "turn.yaw_rate",
    "effective_event": "step.effective_event",
    "cadence_hz": "step.cadence_hz",
    "since_step_s": "step.time_since_effective",
}


def stabilize(frames: DataFrame, fps: float, line: Line = RUNS) -> DataFrame:
    """Root, contacts, slip speeds and the steadier of the two smoothed paths."""
    rate = max(fps, 1.0)
    df = P.with_foot_contact(P.with_root(frames))
    df = P.with_foot_centre(df).withColumn("_joints", F.col("joints")).drop("joints")
    df = df.withColumns(
        {
            "yaw": P.body_axis_angle(F.col("_joints")),
            **{f"la_{a}": c for a, c in zip("xyz", P.joint_world(F.col("_joints"), P.L_ANKLE))},
            **{f"ra_{a}": c for a, c in zip("xyz", P.joint_world(F.col("_joints"), P.R_ANKLE))},
        }
    ).drop("_joints")
    df = cut(df)
    df = df.withColumns({"_plain_x": F.col("root_x"), "_plain_y": F.col("root_y")})
    df = W.smooth_xy(df, "_plain_x", "_plain_y", frames_of(0.60, rate, 1), line)
    df = support_stabilize(df, fps, line)
    df = choose_trajectory(cut(df), ("support_root_x", "support_root_y"), ("_plain_x", "_plain_y"), line)
    return W.slip_speed(
        df, fps, line, slip_left=("lfoot_x", "lfoot_y"), slip_right=("rfoot_x", "rfoot_y")
    ).drop("_plain_x", "_plain_y", "support_root_x", "support_root_y")


def analysis_signals(frames: DataFrame, fps: float, line: Line = RUNS) -> DataFrame:
    """The eleven analysis signals, wide; ``SIGNALS`` maps columns to ids."""
    rate = max(fps, 1.0)
    df = cut(stabilize(frames, fps, line))
    root = P.Vec(F.col("stable_x"), F.col("stable_y"), F.col("root_z"))
    rel = {}
    for side in ("la", "ra"):
        d = P.Vec.cols(side) - root
        rel.update({f"{side}r_{a}": F.coalesce(c, F.lit(0.0)) for a, c in zip("xyz", d)})
    for foot in ("lfoot", "rfoot"):
        f = P.Vec.cols(foot)
        rel.update({f"{foot}r_x": f.x - root.x, f"{foot}r_y": f.y - root.y, f"{foot}r_z": f.z})
    df = df.withColumns(rel)
    feet = {f"{f}r_{a}": f"{f}r_{a}" for f in ("lfoot", "rfoot") for a in "xyz"}
    df = W.carry_forward(df, 0.0, line, **{f"c_{c}": c for c in feet})
    df = W.edge_padded_mean(df, frames_of(0.22, rate, 3), line, m_x="stable_x", m_y="stable_y")
    ankles = {f"m_{s}_{a}": f"{s}r_{a}" for s in ("la", "ra") for a in "xyz"}
    df = W.edge_padded_mean(df, frames_of(0.10, rate, 3), line, **ankles)
    df = W.speed(df, fps, line, root_speed=("m_x", "m_y"), _ankle=tuple(ankles))
    df = W.rolling_mean(df, frames_of(0.35, rate, 3), line, ankle_activity="_ankle")
    df = cut(W.yaw_rate(df, "yaw", fps, "yaw_rate", line))
    sides = []
    for f in ("lfoot", "rfoot"):
        cand = W.foot_lift_candidates(df, f"c_{f}r_x", f"c_{f}r_y", f"c_{f}r_z", fps, line)
        sides.append(E.min_gap_peaks(cand, frames_of(0.25, rate, 1), "lift", line))
    steps = E.refractory_events(sides[0], sides[1], fps, line)
    df = E.step_state(df, steps, fps, line)
    df = W.per_key(df, line, F.count(F.lit(1)).alias("_n"))
    short = F.col("_n") < 3
    late = ("root_speed", "ankle_activity", "yaw_rate", "effective_event", "cadence_hz", "since_step_s")
    df = df.withColumns({c: F.when(~short, F.col(c)) for c in late})
    keep = [c for c in ("video_frame", "mesh_file") if c in df.columns]
    return df.select(
        *line.keys, line.pos, *keep, "subject_present", "left_down", "right_down", "support", *SIGNALS
    )


def gait_layer(frames: DataFrame, contacts: DataFrame, fps: float, cutoff_hz: float = 6.0, line: Line = RUNS):
    """Clinical angles, calibration, events, parameters and cycles of all runs.

    ``contacts``: keys, position, left, right.
    """
    keys = [*line.keys, line.pos]
    need = frames.select(*keys, "subject_present", "joints")
    joined = G.filtered_joints(need, fps, cutoff_hz, line).join(contacts.select(*keys, "left", "right"), keys)
    base = cut(P.with_sagittal_angles(joined))
    static = cut(G.static_frames(base, fps, line))
    neutral = G.neutral_offset(static, fps, line)
    angles = G.apply_neutral(static, neutral, line).select(*keys, *G.ANGLES)
    events = cut(G.gait_events(base, fps, line))
    strides = cut(G.measured_strides(base, events, fps, line))
    steps = G.measured_steps(base, events, fps, line)
    return {
        "neutral": neutral,
        "angles": angles,
        "events": events,
        "strides": strides,
        "parameters": G.spatiotemporal(base, strides, steps, line),
        "cycles": G.cycle_curves(angles, strides, line),
    }


def analyze(frames: DataFrame, fps: float, runs: DataFrame | None = None, line: Line = RUNS) -> dict[str, DataFrame]:
    """Everything the analysis of a set of runs with one frame rate yields.

    ``frames``: run_id, frame_index, subject_present, joints (parsed),
    camera_comp, and optionally video_frame, mesh_file, stability.
    """
    signals = cut(analysis_signals(frames, fps, line))
    contacts = signals.select(
        *line.keys, line.pos, F.col("left_down").alias("left"), F.col("right_down").alias("right")
    )
    gait = gait_layer(frames, contacts, fps, line=line)
    long = to_long(signals, SIGNALS, line).unionByName(to_long(gait["angles"], G.SIGNAL_IDS, line))
    rated = frames if "stability" in frames.columns else frames.withColumn("stability", F.lit(None).cast("double"))
    return {"frames": signals, "signals": long, "qa": qa_summary(rated, runs), **gait}


def analyze_all(frames: DataFrame, runs: DataFrame, most_rates: int = 64) -> dict[str, DataFrame]:
    """``analyze`` for runs of different frame rates, one plan per rate.

    Window sizes are constants of a plan, so runs are grouped by their rate; the
    number of distinct rates is checked.
    """
    rates = [r[0] for r in runs.select("fps").distinct().limit(most_rates + 1).collect()]
    if len(rates) > most_rates:
        raise ValueError(f"more than {most_rates} frame rates; round them first")
    parts = []
    for fps in sorted(rates):
        some = runs.where(F.col("fps") == fps)
        parts.append(analyze(frames.join(some.select("run_id"), "run_id", "left_semi"), fps, some))
    return {
        name: reduce(lambda a, b: a.unionByName(b), [p[name] for p in parts]) for name in parts[0]
    }
