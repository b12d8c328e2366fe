"""Box geometry: a ``Box`` groups four corner columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stridegrid.functions.numbers import clip, finite, norm2, num, round_half_up


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> "Box":
        return Box(*[F.col(f"{prefix}{c}").cast("double") for c in ("x1", "y1", "x2", "y2")])

    @staticmethod
    def from_array(arr: Column) -> "Box":
        return Box(*[arr[i].cast("double") for i in range(4)])

    @staticmethod
    def centred(cx: Column, cy: Column, w: Column, h: Column) -> "Box":
        return Box(cx - w / 2.0, cy - h / 2.0, cx + w / 2.0, cy + h / 2.0)

    @property
    def parts(self) -> tuple[Column, Column, Column, Column]:
        return (self.x1, self.y1, self.x2, self.y2)

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) * 0.5

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) * 0.5

    @property
    def w(self) -> Column:
        return F.greatest(F.lit(1.0), self.x2 - self.x1)

    @property
    def h(self) -> Column:
        return F.greatest(F.lit(1.0), self.y2 - self.y1)

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def raw_area(self) -> Column:
        """Area without the one-pixel floor, never negative."""
        zero = F.lit(0.0)
        return F.greatest(zero, self.x2 - self.x1) * F.greatest(zero, self.y2 - self.y1)

    @property
    def diag(self) -> Column:
        return norm2(self.w, self.h)

    def array(self) -> Column:
        return F.array(*self.parts)

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for n, c in zip(("x1", "y1", "x2", "y2"), self.parts)]

    def map(self, fn) -> "Box":
        return Box(*[fn(c) for c in self.parts])

    def clip_inside(self, width, height) -> "Box":
        """Inside the frame with at least one pixel per side."""
        x1 = clip(self.x1, 0.0, num(width) - 2.0)
        y1 = clip(self.y1, 0.0, num(height) - 2.0)
        return Box(
            x1,
            y1,
            F.least(F.greatest(self.x2, x1 + 1.0), num(width) - 1.0),
            F.least(F.greatest(self.y2, y1 + 1.0), num(height) - 1.0),
        )

    def clip_detector(self, width, height) -> "Box":
        """Detector clip: corners into the frame, no minimum size."""
        return Box(
            clip(self.x1, 0.0, num(width) - 1.0),
            clip(self.y1, 0.0, num(height) - 1.0),
            clip(self.x2, 0.0, num(width)),
            clip(self.y2, 0.0, num(height)),
        )

    def scale(self, s) -> "Box":
        return self.map(lambda c: c * num(s))

    def expand(self, fx, fy, width, height) -> "Box":
        w = F.greatest(F.lit(1.0), (self.x2 - self.x1) * num(fx))
        h = F.greatest(F.lit(1.0), (self.y2 - self.y1) * num(fy))
        return Box.centred(self.cx, self.cy, w, h).clip_inside(width, height)

    def lerp(self, other: "Box", t: Column) -> "Box":
        u = clip(t, 0.0, 1.0)
        return Box(*[a * (1.0 - u) + b * u for a, b in zip(self.parts, other.parts)])

    def blend(self, newer: "Box", alpha) -> "Box":
        a = num(alpha)
        return Box(*[a * n + (1.0 - a) * o for o, n in zip(self.parts, newer.parts)])

    def shift(self, vx: Column, vy: Column, steps) -> "Box":
        """Constant-velocity prediction, size unchanged."""
        k = F.greatest(F.lit(0.0), num(steps))
        return Box.centred(
            self.cx + vx * k, self.cy + vy * k, self.x2 - self.x1, self.y2 - self.y1
        )


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(
        zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    )


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 for an empty union."""
    inter = intersection(a, b)
    union = a.raw_area + b.raw_area - inter
    return F.when(union > 1e-6, inter / union).otherwise(0.0)


def iou_floored(a: Box, b: Box) -> Column:
    """Tracker variant: sides count as at least one pixel."""
    inter = intersection(a, b)
    union = a.area + b.area - inter
    return F.when((inter > 0) & (union > 1e-6), inter / union).otherwise(0.0)


def norm_xywh(b: Box, width, height) -> list[Column]:
    """Corner and size as fractions of the frame, 5 decimals."""
    w, h = num(width), num(height)
    return [
        F.bround(b.x1 / w, 5),
        F.bround(b.y1 / h, 5),
        F.bround((b.x2 - b.x1) / w, 5),
        F.bround((b.y2 - b.y1) / h, 5),
    ]


def denorm_xyxy(x: Column, y: Column, w: Column, h: Column, width, height) -> list[Column]:
    """Fractions back to whole pixels, rounding half up."""
    W, H = num(width), num(height)
    return [
        round_half_up(x * W),
        round_half_up(y * H),
        round_half_up((x + w) * W),
        round_half_up((y + h) * H),
    ]


def box_payload(b: Box, width, height) -> list[Column]:
    w, h = F.greatest(F.lit(1.0), num(width)), F.greatest(F.lit(1.0), num(height))
    return [
        clip(b.x1 / w, 0.0, 1.0),
        clip(b.y1 / h, 0.0, 1.0),
        clip((b.x2 - b.x1) / w, 0.0, 1.0),
        clip((b.y2 - b.y1) / h, 0.0, 1.0),
    ]


def valid_box(b: Box, present: Column) -> Column:
    return F.coalesce(present & (b.x2 > b.x1) & (b.y2 > b.y1), F.lit(False))


def feet_visible(bottom: Column, height) -> Column:
    """False where the picture edge cuts the lower body off."""
    return F.coalesce(bottom < num(height) * 0.985, F.lit(False))


def adaptive_alpha(old: Box, new: Box, slow=0.55, fast=0.95, ratio=0.10) -> Column:
    """Blend weight that grows with the motion relative to the box diagonal."""
    moved = norm2(new.cx - old.cx, new.cy - old.cy) / new.diag
    return slow + (fast - slow) * clip(moved / max(1e-6, ratio), 0.0, 1.0)


def stability_score(
    cand: Box, pred: Box, appearance: Column, jump_ratio: float = 0.35
) -> dict[str, Column]:
    """Weighted agreement of a candidate box with its prediction."""
    dist = norm2(cand.cx - pred.cx, cand.cy - pred.cy)
    ratio = dist / F.greatest(F.lit(1e-6), pred.diag)
    motion = clip(1.0 - ratio / max(1e-6, jump_ratio), 0.0, 1.0)
    overlap = iou_floored(cand, pred)
    scale_ratio = F.greatest(cand.area, F.lit(1.0)) / F.greatest(pred.area, F.lit(1.0))
    scale = F.exp(-F.abs(F.log(F.greatest(scale_ratio, F.lit(1e-6)))))
    app = F.coalesce(clip(appearance, 0.0, 1.0), F.lit(0.5))
    return {
        "combined": 0.44 * app + 0.28 * motion + 0.18 * overlap + 0.10 * scale,
        "motion_score": motion,
        "iou": overlap,
        "scale_score": scale,
    }


def leg_strip(b: Box) -> Box:
    """Central lower strip of a person box, where clothing colour is sampled."""
    w, h = b.x2 - b.x1, b.y2 - b.y1
    return Box(b.x1 + 0.30 * w, b.y1 + 0.55 * h, b.x2 - 0.30 * w, b.y1 + 0.92 * h)


def strip_cover(strip: Box, other: Box) -> Column:
    """Share of a strip covered by another box."""
    size = F.greatest(F.lit(1e-6), (strip.x2 - strip.x1) * (strip.y2 - strip.y1))
    return intersection(strip, other) / size


def candidate_score(b: Box, width, height, score: Column) -> Column:
    """Geometry and confidence score of a subject candidate, 0..1."""
    w, h = F.greatest(F.lit(1.0), num(width)), F.greatest(F.lit(1.0), num(height))
    zero = F.lit(0.0)
    slender = F.greatest(zero, 1.0 - F.abs(b.w / b.h - 0.45) / 0.45)
    centre = F.greatest(zero, 1.0 - F.abs(b.cx / w - 0.42) / 0.42)
    conf = F.coalesce(clip(score / 3.0, 0.0, 1.0), F.lit(0.5))
    return (
        0.30 * clip(b.h / h, 0.0, 1.0)
        + 0.18 * clip(b.area / (w * h), 0.0, 1.0)
        + 0.20 * slender
        + 0.12 * clip(b.y2 / h, 0.0, 1.0)
        + 0.10 * centre
        + 0.10 * conf
    )


def pinhole_project(x: Column, y: Column, z: Column, focal: Column, width, height):
    """Image point of a camera-space point and whether it lies before the camera."""
    ok = z > 1e-6
    u = F.when(ok, focal * x / z + num(width) / 2.0)
    v = F.when(ok, focal * y / z + num(height) / 2.0)
    return u, v, F.coalesce(ok, F.lit(False))


def rect_pad(
    lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column, n: Column, width, height,
    pad: float = 0.20, min_points: int = 5, min_size: float = 60, both_small: bool = False,
) -> Box:
    """Padded rectangle of a point set; null corners when too few or too small."""
    bw, bh = hi_x - lo_x, hi_y - lo_y
    box = Box(lo_x - bw * pad, lo_y - bh * pad, hi_x + bw * pad, hi_y + bh * pad)
    box = box.clip_inside(width, height)
    w_small, h_small = (box.x2 - box.x1) < min_size, (box.y2 - box.y1) < min_size
    small = (w_small & h_small) if both_small else (w_small | h_small)
    flat = (bw <= 0) | (bh <= 0) if both_small else (bw < 1) | (bh < 1)
    ok = (n >= min_points) & ~flat & ~small
    return box.map(lambda c: F.when(ok, c))


def parse_box(text: Column) -> Box:
    """``"x1,y1,x2,y2"`` as whole pixels with x2 > x1 and y2 > y1, else null corners."""
    parts = F.split(text, ",")
    vals = [F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in range(4)]
    ok = F.size(parts) == 4
    for v in vals:
        ok = ok & F.coalesce(finite(v), F.lit(False))
    px = [F.greatest(F.lit(0), round_half_up(v)).cast("double") for v in vals]
    ok = ok & (px[2] > px[0]) & (px[3] > px[1])
    return Box(*[F.when(ok, v) for v in px])


def default_box(width, height) -> Box:
    w, h = num(width), num(height)
    return Box(w * 0.25, h * 0.10, w * 0.75, h * 0.98)


def track_color(track_id: Column) -> Column:
    # Display palette, used in order.
    palette = [
        "#34d399", "#60a5fa", "#f472b6", "#fbbf24", "#a78bfa",
        "#fb7185", "#4ade80", "#38bdf8", "#facc15", "#c084fc",
    ]
    at = F.pmod(track_id, F.lit(len(palette))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(c) for c in palette]), at)
