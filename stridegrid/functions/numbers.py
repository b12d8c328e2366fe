"""Small numeric column helpers shared by the other modules."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def frames_of(seconds: float, fps: float, least: int = 0) -> int:
    """Frame count of a duration, rounded half to even, at least ``least``."""
    return max(least, int(Decimal(str(seconds * fps)).quantize(Decimal(1), ROUND_HALF_EVEN)))


def clip(x: Column, lo, hi) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, num(lo)), num(hi)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def numeric_or_default(x: Column, default: float) -> Column:
    return F.when(finite(x), x).otherwise(F.lit(float(default)))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def wrap_deg(angle: Column) -> Column:
    """Angle in (-180, 180]."""
    return angle - 360.0 * F.ceil((angle - 180.0) / 360.0)


def norm2(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded for output: ties broken upwards, never minus zero."""
    return F.when(F.abs(x) < 0.5 * 10.0**-digits, F.lit(0.0)).otherwise(
        F.round(x + 3e-11, digits)
    )


def camera_motion_severity(shift_px: Column) -> Column:
    """Mean camera step in pixels as a severity in [0, 1]; null if unusable."""
    return clip(finite_or_null(shift_px) / 15.0, 0.0, 1.0)


def one_euro_alpha(cutoff_hz: Column, dt_s: Column) -> Column:
    tau = 1.0 / (2.0 * math.pi * F.greatest(cutoff_hz, F.lit(1e-6)))
    return 1.0 / (1.0 + tau / F.greatest(dt_s, F.lit(1e-6)))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, clip(100.0 * done / total, 0.0, 100.0))
