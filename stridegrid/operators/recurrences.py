"""Filters and other recurrences along a run, solved block by block."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridegrid.functions.numbers import finite, frames_of
from stridegrid.operators.windows import linear_gap_fill, per_key, smooth_xy
from stridegrid.plans.blocks import (
    RUNS, Line, _with_halo, affine_recurrence, for_python, neighbourhood, running, stateful_rows,
)
from stridegrid.plans.session import one_blas_thread

ORDER = 4
PAD = 3 * (ORDER + 1)


def lowpass_coefficients(fps: float, cutoff_hz: float) -> tuple[np.ndarray, np.ndarray]:
    """Order-4 Butterworth low-pass by the bilinear transform."""
    wn = min(0.99, cutoff_hz / (max(fps, 1.0) / 2.0))
    warped = 4.0 * math.tan(math.pi * wn / 2.0)
    k = np.arange(1, ORDER + 1)
    analog = warped * np.exp(1j * math.pi * (2 * k + ORDER - 1) / (2 * ORDER))
    poles = (4.0 + analog) / (4.0 - analog)
    a = np.real(np.poly(poles))
    b = np.poly(-np.ones(ORDER)) * (a.sum() / 2.0**ORDER)
    return b, a


#: Rows that one matrix product filters.
CHUNK = 128


@dataclass(frozen=True)
class ChunkFilter:
    """A filter as a state-space system over chunks of rows.

    With ``z' = A z + B x`` and ``y = b0 x + z[0]``, the outputs of a chunk are
    ``response @ x + memory @ z`` and the next state is ``powered @ z + push @ x``;
    powers of the companion matrix A give all four.
    """

    response: np.ndarray
    memory: np.ndarray
    powered: np.ndarray
    push: np.ndarray
    settled: np.ndarray

    @classmethod
    def of(cls, b: np.ndarray, a: np.ndarray, rows: int = CHUNK) -> ChunkFilter:
        n = len(a) - 1
        companion = np.zeros((n, n))
        companion[:, 0] = -a[1:]
        companion[:-1, 1:] = np.eye(n - 1)
        drive = b[1:] - a[1:] * b[0]
        powers = [np.eye(n)]
        for _ in range(rows):
            powers.append(companion @ powers[-1])
        memory = np.stack([p[0] for p in powers[:rows]])
        impulse = np.concatenate(([b[0]], memory[: rows - 1] @ drive))
        lag = np.subtract.outer(np.arange(rows), np.arange(rows))
        return cls(
            np.where(lag >= 0, impulse[np.abs(lag)], 0.0),
            memory,
            powers[rows],
            np.stack([p @ drive for p in powers[:rows]][::-1], axis=1),
            np.linalg.solve(np.eye(n) - companion, drive),
        )

    def run(self, x: np.ndarray) -> np.ndarray:
        """One pass over the rows of ``x`` (time by channel) from a state that holds the first row."""
        rows, n = len(self.response), len(x)
        count = -(-n // rows)
        chunks = np.concatenate((x, np.repeat(x[-1:], count * rows - n, axis=0))).reshape(count, rows, -1)
        pushes = np.einsum("sr,krc->ksc", self.push, chunks, optimize=True)
        z = np.outer(self.settled, x[0])
        states = np.empty_like(pushes)
        for k in range(count):
            states[k] = z
            z = self.powered @ z + pushes[k]
        y = np.einsum("tr,krc->ktc", self.response, chunks, optimize=True) + self.memory @ states
        return y.reshape(count * rows, -1)[:n]


def both_ways(held: ChunkFilter, x: np.ndarray, head: bool, tail: bool) -> np.ndarray:
    """Forward and backward pass; real ends are extended by point reflection."""
    parts = [x]
    if head:
        parts.insert(0, 2 * x[0] - x[PAD:0:-1])
    if tail:
        parts.append(2 * x[-1] - x[-2 : -PAD - 2 : -1])
    ext = np.concatenate(parts)
    y = held.run(held.run(ext)[::-1])[::-1]
    lead = PAD if head else 0
    return y[lead : lead + len(x)]


def settle_rows(a: np.ndarray, eps: float = 1e-17) -> int:
    """Rows after which the filter has forgotten its start."""
    radius = max(abs(np.roots(a)))
    return int(math.ceil(math.log(eps) / math.log(radius))) + ORDER


def zero_phase_lowpass(
    df: DataFrame, columns: list[str], fps: float, cutoff_hz: float = 6.0, line: Line = RUNS
) -> DataFrame:
    """Zero-phase low-pass of each column; gaps are bridged and restored.

    Runs of up to 15 rows and columns with fewer than 8 finite values pass
    unchanged. A block is filtered with as many rows of its neighbours as the
    filter remembers, so blocks are independent and agree with one long pass.
    """
    b, a = lowpass_coefficients(fps, cutoff_hz)
    chunked = ChunkFilter.of(b, a)
    halo = settle_rows(a) * 2 + PAD
    keys, pos, block = list(line.keys), line.pos, line.block
    counted = per_key(
        df,
        line,
        F.max(pos).alias("_last"),
        *[F.sum(finite(F.col(c)).cast("int")).alias(f"_k_{c}") for c in columns],
    )
    bridged = linear_gap_fill(counted, line, **{f"_f_{c}": c for c in columns})
    spread = for_python(_with_halo(bridged, line, halo, halo), *keys, "_blk")
    kept = list(df.columns)
    schema = T.StructType([df.schema[c] for c in kept])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        own = (pdf["_home"] == pdf["_blk"]).to_numpy()
        if not own.any():
            return pdf.loc[own, kept]
        out = pdf.loc[own, kept].copy()
        last = int(pdf["_last"].iloc[0])
        if last + 1 <= PAD:
            return out
        usable = [c for c in columns if pdf[f"_k_{c}"].iloc[0] >= 8]
        if not usable:
            return out
        at = pdf[pos].to_numpy()
        x = pdf[[f"_f_{c}" for c in usable]].to_numpy(dtype=float)
        one_blas_thread()
        y = both_ways(chunked, x, at[0] == 0, at[-1] == last)[own]
        raw = pdf.loc[own, usable].to_numpy(dtype=float)
        y[~np.isfinite(raw)] = np.nan
        for i, c in enumerate(usable):
            out[c] = pd.Series(y[:, i], index=out.index).astype(object).where(
                np.isfinite(y[:, i]), None
            )
        return out

    return spread.groupBy(*keys, "_blk").applyInPandas(solve, schema)


def support_stabilize(
    df: DataFrame, fps: float, line: Line = RUNS,
    x: str = "root_x", y: str = "root_y",
    support: str = "support", support_x: str = "support_x", support_y: str = "support_y",
) -> DataFrame:
    """Pull the root towards the supporting foot, then smooth.

    Within one support phase the correction follows
    ``d' = 0.78 d + 0.22 (s0 - s)`` from zero; phases add up, so it is a linear
    recurrence inside phases plus a running sum over phases.
    """
    ok = F.col(support_x).isNotNull()
    df = neighbourhood(df, line, 1, lambda w: {"_was": F.lag(support).over(w)})
    df = df.withColumn("_new", ok & (F.col("_was").isNull() | (F.col(support) != F.col("_was"))))
    at = F.when(F.col("_new"), F.struct(F.col(support_x).alias("x"), F.col(support_y).alias("y")))
    df = running(df, line, _s0=("last", at))
    keep = F.when(F.col("_new"), 0.0).when(ok, 0.78).otherwise(1.0)
    push = lambda c, axis: F.when(ok & ~F.col("_new"), 0.22 * (F.col("_s0")[axis] - F.col(c))).otherwise(0.0)
    df = df.withColumns({"_k": keep, "_bx": push(support_x, "x"), "_by": push(support_y, "y")})
    df = df.drop("_was", "_s0")
    df = affine_recurrence(
        df, line, _dx=(F.col("_k"), F.col("_bx")), _dy=(F.col("_k"), F.col("_by"))
    )
    df = neighbourhood(df, line, 1, lambda w: {"_ex": F.lag("_dx").over(w), "_ey": F.lag("_dy").over(w)})
    ended = lambda c: F.when(F.col("_new"), F.col(c)).otherwise(0.0)
    df = running(df, line, _sx=("sum", ended("_ex")), _sy=("sum", ended("_ey")))
    df = df.withColumns(
        {
            "support_root_x": F.col(x) + F.col("_dx") + F.coalesce("_sx", F.lit(0.0)),
            "support_root_y": F.col(y) + F.col("_dy") + F.coalesce("_sy", F.lit(0.0)),
        }
    ).drop("_new", "_k", "_bx", "_by", "_dx", "_dy", "_ex", "_ey", "_sx", "_sy")
    return smooth_xy(df, "support_root_x", "support_root_y", frames_of(0.22, max(fps, 1.0), 1), line)


# Minimum cutoff (Hz) and speed coefficient of the filter presets.
ONE_EURO = {
    "x": (1.0, 0.3), "y": (0.5, 0.15), "z": (1.2, 0.4), "lift": (1.5, 0.6), "upright": (0.4, 1.0),
}


def _alpha(cutoff: float, dt: float) -> float:
    return 1.0 / (1.0 + (1.0 / (2 * math.pi * max(cutoff, 1e-6))) / max(dt, 1e-6))


def adaptive_lowpass(value: float, state, dt: float, floor: float, beta: float):
    """One sample of the speed-adaptive low-pass; state is (value, slope)."""
    if state is None:
        return value, (value, 0.0)
    held, slope = state
    slope += _alpha(1.0, dt) * ((value - held) / max(dt, 1e-6) - slope)
    held += _alpha(floor + beta * abs(slope), dt) * (value - held)
    return held, (held, slope)


def one_euro(
    df: DataFrame, fps: float, columns: dict[str, tuple[str, float, float]], line: Line = RUNS
) -> DataFrame:
    """Speed-adaptive low-pass, ``out: (input, min_cutoff, beta)``.

    The first sample passes, missing samples stay missing and hold the state.
    """
    dt = 1.0 / max(1.0, fps)
    outs = list(columns)

    def step(state, pdf):
        flat = [math.nan] * (2 * len(outs)) if state is None else [float(v) for v in state]
        result = pdf[[*line.keys, line.pos]].copy()
        for i, (name, (source, floor, beta)) in enumerate(columns.items()):
            st = None if math.isnan(flat[2 * i]) else (flat[2 * i], flat[2 * i + 1])
            series = []
            for v in pdf[source].to_numpy(dtype=float).tolist():
                if math.isfinite(v):
                    y, st = adaptive_lowpass(v, st, dt, floor, beta)
                    series.append(y)
                else:
                    series.append(None)
            result[name] = pd.Series(series, index=result.index, dtype=object)
            if st is not None:
                flat[2 * i], flat[2 * i + 1] = st
        return result, np.asarray(flat)

    slowest = min(_alpha(floor, dt) for _, floor, _ in columns.values())
    warmup = int(math.ceil(40.0 / -math.log1p(-slowest)))
    fields = [T.StructField(n, T.DoubleType()) for n in outs]
    need = df.select(*line.keys, line.pos, *dict.fromkeys(c for c, _, _ in columns.values()))
    solved = stateful_rows(need, line, step, fields, warmup)
    return df.join(solved, [*line.keys, line.pos], "left")


def ema(df: DataFrame, column: str, alpha: float, out: str, line: Line = RUNS) -> DataFrame:
    """Exponential mean; the first value starts it, missing values hold it."""
    v = F.col(column)
    scanned = running(df, line, _had=("prev", F.when(v.isNotNull(), F.lit(1))))
    starts = F.col("_had").isNull()
    a = F.when(v.isNull(), 1.0).when(starts, 0.0).otherwise(1.0 - alpha)
    b = F.when(v.isNull(), 0.0).when(starts, v).otherwise(alpha * v)
    scanned = scanned.withColumns({"_a": a, "_b": b})
    return affine_recurrence(scanned, line, **{out: (F.col("_a"), F.col("_b"))}).drop(
        "_had", "_a", "_b"
    )


def adaptive_box_ema(
    df: DataFrame, line: Line = RUNS, slow: float = 0.55, fast: float = 0.95, ratio: float = 0.10
) -> DataFrame:
    """Box mean whose weight grows with the motion of the new box."""
    corners = ["x1", "y1", "x2", "y2"]
    outs = [f"smooth_{c}" for c in corners]

    def step(state, pdf):
        result = pdf[[*line.keys, line.pos]].copy()
        boxes = pdf[corners].to_numpy(dtype=float)
        smooth = []
        held = None if state is None else tuple(float(v) for v in state)
        for new in boxes.tolist():
            if held is None:
                held = tuple(new)
            else:
                (a1, b1, a2, b2), (c1, d1, c2, d2) = new, held
                move = math.hypot(((a1 + a2) - (c1 + c2)) * 0.5, ((b1 + b2) - (d1 + d2)) * 0.5)
                diag = math.hypot(max(1.0, a2 - a1), max(1.0, b2 - b1))
                t = min(1.0, move / diag / max(1e-6, ratio))
                w = slow + (fast - slow) * t
                held = tuple(w * n + (1.0 - w) * h for n, h in zip(new, held))
            smooth.append(held)
        result[outs] = np.array(smooth).reshape(-1, 4)
        return result, np.asarray(held, dtype=float)

    fields = [T.StructField(n, T.DoubleType()) for n in outs]
    warmup = int(math.ceil(40.0 / -math.log1p(-slow)))
    solved = stateful_rows(df.select(*line.keys, line.pos, *corners), line, step, fields, warmup)
    return df.join(solved, [*line.keys, line.pos], "left")
