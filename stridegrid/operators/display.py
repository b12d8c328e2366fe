"""Display-side series: anchored root, lift, upright rotation, sole pitch."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridegrid.functions.numbers import norm2
from stridegrid.operators.recurrences import ONE_EURO, adaptive_lowpass, one_euro
from stridegrid.operators.windows import per_key
from stridegrid.plans.blocks import RUNS, Line, neighbourhood, running, stateful_rows
from stridegrid.plans.quantiles import exact_quantiles

MAX_CORRECTION_M = 2.0
CONTACT_SNAP_M = 0.05
GROUND_SHARE = 0.10


def anchor_trajectory(
    df: DataFrame, line: Line = RUNS, limit_m: float = MAX_CORRECTION_M,
    x: str = "root_x", y: str = "root_y",
    support: str = "support", support_x: str = "support_x", support_y: str = "support_y",
) -> DataFrame:
    """Hold the supporting foot still: adds anchored_x and anchored_y.

    While the same foot supports consecutive rows its drift is taken back, so
    the correction is a running sum. Only runs whose correction would pass
    ``limit_m`` go through the row-by-row form that clamps its length.
    """
    stepped = neighbourhood(
        df, line, 1,
        lambda w: {
            "_same": F.coalesce(
                (F.lag(support).over(w) == F.col(support)) & F.lag(support_x).over(w).isNotNull(),
                F.lit(False),
            ),
            "_px": F.lag(support_x).over(w),
            "_py": F.lag(support_y).over(w),
        },
    )
    back = lambda p, c: F.when(F.col("_same"), F.coalesce(F.col(p) - F.col(c), F.lit(0.0))).otherwise(0.0)
    summed = running(
        stepped, line, _cx=("sum", back("_px", support_x)), _cy=("sum", back("_py", support_y))
    )
    reach = norm2(F.col("_cx"), F.col("_cy"))
    out = per_key(summed, line, F.max(reach).alias("_reach"))
    if limit_m < 1e8 and not out.where(F.col("_reach") > limit_m).isEmpty():
        clamped = _clamped_correction(
            out.where(F.col("_reach") > limit_m).select(*line.keys, line.pos, support, support_x, support_y),
            line, limit_m, support, support_x, support_y,
        )
        out = out.join(clamped, [*line.keys, line.pos], "left").withColumns(
            {"_cx": F.coalesce("_kx", "_cx"), "_cy": F.coalesce("_ky", "_cy")}
        ).drop("_kx", "_ky")
    return out.withColumns(
        {"anchored_x": F.col(x) + F.col("_cx"), "anchored_y": F.col(y) + F.col("_cy")}
    ).drop("_same", "_px", "_py", "_cx", "_cy", "_reach")


def _clamped_correction(df, line: Line, limit: float, support: str, sx: str, sy: str) -> DataFrame:
    names = {"none": 0.0, "left": 1.0, "right": 2.0, "both": 3.0}

    def step(state, pdf):
        cx, cy, ax, ay, last = [0.0, 0.0, math.nan, math.nan, 0.0] if state is None else list(state)
        xs, ys = [], []
        for s, px, py in zip(pdf[support], pdf[sx].to_numpy(float), pdf[sy].to_numpy(float)):
            now = names[s] if math.isfinite(px) else 0.0
            if now:
                if now != last or math.isnan(ax):
                    ax, ay = px + cx, py + cy
                cx, cy = ax - px, ay - py
                size = math.hypot(cx, cy)
                if size > limit:
                    cx, cy = cx * limit / size, cy * limit / size
            last = now
            xs.append(cx)
            ys.append(cy)
        out = pdf[[*line.keys, line.pos]].copy()
        out["_kx"], out["_ky"] = xs, ys
        return out, np.asarray([cx, cy, ax, ay, last])

    fields = [T.StructField("_kx", T.DoubleType()), T.StructField("_ky", T.DoubleType())]
    return stateful_rows(df, line, step, fields, warmup=0)


def ground_height(df: DataFrame, height: str, line: Line = RUNS) -> DataFrame:
    """Per run, the height below which a tenth of the values lie."""
    return exact_quantiles(df, list(line.keys), height, {"ground": GROUND_SHARE}, floor_rank=True)


def lift_series(df: DataFrame, height: str, fps: float, line: Line = RUNS) -> DataFrame:
    """Smoothed clearance over the ground, snapped to zero near it."""
    out = df.join(ground_height(df, height, line), list(line.keys), "left")
    out = out.withColumn("_clear", F.col(height) - F.col("ground"))
    out = one_euro(out, fps, {"_smooth": ("_clear", *ONE_EURO["lift"])}, line)
    lift = F.greatest(F.lit(0.0), F.col("_smooth") - CONTACT_SNAP_M)
    return out.withColumn("lift", F.coalesce(lift, F.lit(0.0))).drop("_clear", "_smooth", "ground")


def _slerp(p: np.ndarray, q: np.ndarray, t: float) -> np.ndarray:
    d = float(p @ q)
    if d < 0:
        q, d = -q, -d
    if d > 1 - 1e-12:
        r = p + t * (q - p)
    else:
        angle = math.acos(min(1.0, d))
        r = (math.sin((1 - t) * angle) * p + math.sin(t * angle) * q) / math.sin(angle)
    return r / np.linalg.norm(r)


def _upright_of(up: np.ndarray) -> np.ndarray:
    """Rotation (w, x, y, z) that stands a leaning body up, faded for postures."""
    still = np.array([1.0, 0.0, 0.0, 0.0])
    tilt = math.degrees(math.acos(max(-1.0, min(1.0, up[2]))))
    if tilt < 2.0 or tilt >= 50.0:
        return still
    half = np.array([1.0 + up[2], up[1], -up[0], 0.0])
    full = half / np.linalg.norm(half)
    return full if tilt <= 25.0 else _slerp(still, full, 1.0 - (tilt - 25.0) / 25.0)


def upright_series(df: DataFrame, fps: float, line: Line = RUNS) -> DataFrame:
    """Smoothed upright rotation per row from ``up_x/_y/_z``; adds q_w..q_z."""
    dt = 1.0 / max(1.0, fps)
    floor, beta = ONE_EURO["upright"]
    outs = ["q_w", "q_x", "q_y", "q_z"]

    def step(state, pdf):
        flat = [math.nan] * 10 if state is None else list(state)
        axes = [None if math.isnan(flat[2 * i]) else (flat[2 * i], flat[2 * i + 1]) for i in range(3)]
        q = None if math.isnan(flat[6]) else np.asarray(flat[6:10])
        rows = []
        for up in pdf[["up_x", "up_y", "up_z"]].to_numpy(dtype=float):
            target = None
            if np.isfinite(up).all():
                smooth = np.empty(3)
                for i in range(3):
                    smooth[i], axes[i] = adaptive_lowpass(up[i], axes[i], dt, floor, beta)
                n = np.linalg.norm(smooth)
                unit = smooth / n if n > 1e-5 else up
                target = _upright_of(unit)
            if q is None:
                q = np.array([1.0, 0.0, 0.0, 0.0]) if target is None else target
            elif target is not None:
                jump = 2 * math.degrees(math.acos(min(1.0, abs(float(q @ target)))))
                q = _slerp(q, target, 0.10 if jump > 28.0 else 0.25)
            rows.append(q)
        out = pdf[[*line.keys, line.pos]].copy()
        out[outs] = np.asarray(rows, dtype=float)
        flat = [v for a in axes for v in (a or (math.nan, math.nan))]
        flat += [math.nan] * 4 if q is None else list(q)
        return out, np.asarray(flat)

    fields = [T.StructField(n, T.DoubleType()) for n in outs]
    need = df.select(*line.keys, line.pos, "up_x", "up_y", "up_z")
    return stateful_rows(need, line, step, fields, warmup=600)
