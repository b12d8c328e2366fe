"""Interval operators: merge, complement, visible segments, time remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegrid.operators.joins import asof
from stridegrid.plans.blocks import DEFAULT_BLOCK_ROWS, Line, running
from stridegrid.plans.session import cut

MIN_SPAN_S = 0.05
JOIN_GAP_S = 0.01
MIN_TRIM_GAP_S = 0.1


def _line(on: list[str], block: int = DEFAULT_BLOCK_ROWS) -> Line:
    return Line(tuple(on), "start_sec", block, ("end_sec",))


def merge_intervals(
    spans: DataFrame, on: list[str], lower: Column | float = 0.0, upper: Column | float | None = None
) -> DataFrame:
    """Clamp, order, drop spans under 0.05 s and merge those that touch."""
    low = lower if isinstance(lower, Column) else F.lit(float(lower))
    a, b = F.least("start_sec", "end_sec"), F.greatest("start_sec", "end_sec")
    top = b if upper is None else F.least(b, upper if isinstance(upper, Column) else F.lit(float(upper)))
    clean = spans.select(*on, F.greatest(a, low).alias("start_sec"), top.alias("end_sec")).where(
        F.col("end_sec") - F.col("start_sec") >= MIN_SPAN_S
    )
    clean = clean.groupBy(*on, "start_sec").agg(F.max("end_sec").alias("end_sec"))
    seen = running(clean, _line(on), _reach=("max_before", F.col("end_sec")))
    starts = F.col("_reach").isNull() | (F.col("start_sec") > F.col("_reach") + JOIN_GAP_S)
    grouped = running(
        seen.withColumn("_new", starts.cast("int")), _line(on), _grp=("sum", F.col("_new"))
    )
    return grouped.groupBy(*on, "_grp").agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")
    ).drop("_grp")


def keep_ranges(
    merged: DataFrame, on: list[str], trim_start: float = 0.0, trim_end: float | None = None
) -> DataFrame:
    """Gaps of at least 0.05 s between merged spans; the tail is open without an end."""
    begin = max(0.0, trim_start)
    keyed = running(
        merged, _line(on), _prev=("max_before", F.col("end_sec")), _next=("after", F.col("start_sec"))
    )
    before = keyed.select(
        *on,
        F.greatest(F.coalesce("_prev", F.lit(begin)), F.lit(begin)).alias("start_sec"),
        F.col("start_sec").alias("end_sec"),
    )
    tail = keyed.where(F.col("_next").isNull()).select(
        *on,
        F.greatest("end_sec", F.lit(begin)).alias("start_sec"),
        F.lit(trim_end).cast("double").alias("end_sec"),
    )
    wide = F.col("end_sec").isNull() | (F.col("end_sec") - F.col("start_sec") >= MIN_SPAN_S)
    return before.where(F.col("end_sec").isNotNull()).unionByName(tail).where(wide)


def visible_segments(
    bounds: DataFrame, cuts: DataFrame, removed: DataFrame, on: list[str]
) -> DataFrame:
    """Kept pieces after trim, cuts and removed spans, with display offsets.

    ``bounds``: on..., trim_start, trim_end; ``cuts``: on..., cut_sec;
    ``removed``: merged spans. Pieces under 0.1 s vanish; index starts at 1.
    """
    gap = MIN_TRIM_GAP_S
    b = bounds.select(
        *on, F.least("trim_start", "trim_end").alias("_lo"), F.greatest("trim_start", "trim_end").alias("_hi")
    ).where(F.col("_hi") - F.col("_lo") >= gap)
    inner = cuts.join(b, on).where(
        (F.col("cut_sec") > F.col("_lo") + gap) & (F.col("cut_sec") < F.col("_hi") - gap)
    )
    marks = b.select(*on, F.col("_lo").alias("start_sec")).unionByName(
        inner.select(*on, F.col("cut_sec").alias("start_sec"))
    )
    marks = marks.withColumn("end_sec", F.lit(None).cast("double"))
    ends = removed.join(b, on).where("end_sec > _lo AND start_sec < _hi")
    edges = (
        marks.withColumn("_cut", F.lit(True))
        .select(*on, "start_sec", "end_sec", "_cut")
        .unionByName(ends.select(*on, "start_sec", "end_sec", F.lit(False).alias("_cut")))
        .join(b, on)
    )
    line = Line(tuple(on), "start_sec", DEFAULT_BLOCK_ROWS, ("_cut",))
    edges = running(
        edges, line,
        _reach=("max_before", F.col("end_sec")),
        _next=("after", F.col("start_sec")),
        _stop=("max", F.col("end_sec")),
    )
    edges = cut(edges)
    # a piece begins at a boundary or at the end of a removed span
    begin = F.greatest(
        F.when(F.col("_cut"), F.greatest("start_sec", F.coalesce("_reach", F.col("_lo")))).otherwise(F.col("end_sec")),
        F.col("_lo"),
    )
    finish = F.least(F.coalesce("_next", F.col("_hi")), F.col("_hi"))
    pieces = edges.select(*on, begin.alias("start_sec"), finish.alias("end_sec")).where(
        F.col("end_sec") - F.col("start_sec") >= gap
    )
    numbered = running(
        pieces, _line(on),
        _off=("sum_before", F.col("end_sec") - F.col("start_sec")),
        _idx=("sum", F.lit(1)),
    )
    off = F.coalesce("_off", F.lit(0.0))
    # read several times by the time remaps
    return cut(
        numbered.select(
            *on,
            F.col("_idx").cast("long").alias("index"),
            "start_sec",
            "end_sec",
            off.alias("display_start"),
            (off + F.col("end_sec") - F.col("start_sec")).alias("display_end"),
        )
    )


def original_to_edited(
    points: DataFrame, removed: DataFrame, on: list[str], at: str = "t", trim: float = 0.0
) -> DataFrame:
    """Time in the edited video: what was removed before the point is taken off."""
    trim = max(0.0, trim)
    size = F.greatest(F.lit(0.0), F.greatest("end_sec", F.lit(trim)) - F.greatest("start_sec", F.lit(trim)))
    sized = running(removed.withColumn("_len", size), _line(on), _gone=("sum_before", F.col("_len")))
    out = asof(points, sized, on, at, "start_sec", ["end_sec", "_gone"], strict=True)
    last = F.col("before")
    partial = F.greatest(
        F.lit(0.0),
        F.least(F.greatest(last["end_sec"], F.lit(trim)), F.col(at)) - F.greatest(last["at"], F.lit(trim)),
    )
    gone = F.coalesce(F.coalesce(last["_gone"], F.lit(0.0)) + partial, F.lit(0.0))
    return out.withColumn("edited", F.greatest(F.lit(0.0), F.col(at) - trim - gone)).drop("before")


def edited_to_original(points: DataFrame, visible: DataFrame, on: list[str], at: str = "t") -> DataFrame:
    """Source time of an offset on the gap-free timeline."""
    ends = visible.groupBy(*on).agg(F.max("display_end").alias("_last"))
    clamped = points.join(ends, on).withColumn(
        "_off", F.least(F.greatest(F.col(at), F.lit(0.0)), F.col("_last"))
    )
    # the first piece whose display end is at or past the offset, less 1 ms
    shifted = clamped.withColumn("_probe", F.col("_off") - 0.001)
    out = asof(shifted, visible, on, "_probe", "display_end", ["index"], forward=True, strict=True)
    piece = visible.select(
        *on, F.col("index").alias("_i"), F.col("start_sec").alias("_s"), F.col("end_sec").alias("_e"),
        F.col("display_start").alias("_d"),
    )
    out = out.withColumn("_i", F.col("after.index")).join(piece, [*on, "_i"], "left")
    t = F.col("_s") + F.col("_off") - F.col("_d")
    return out.withColumn(
        "original", F.least(F.greatest(t, F.col("_s")), F.col("_e"))
    ).drop("_last", "_off", "_probe", "before", "after", "_i", "_s", "_e", "_d")


def timeline_offset(points: DataFrame, visible: DataFrame, on: list[str], at: str = "t") -> DataFrame:
    """Offset on the gap-free timeline of a source time."""
    ends = visible.groupBy(*on).agg(F.max("display_end").alias("_last"))
    out = asof(
        points.join(ends, on), visible, on, at, "end_sec",
        ["start_sec", "display_start"], forward=True, strict=True,
    )
    nxt = F.col("after")
    inside = F.least(F.greatest(F.col(at) - nxt["start_sec"], F.lit(0.0)), nxt["at"] - nxt["start_sec"])
    return out.withColumn(
        "offset", F.when(nxt.isNull(), F.col("_last")).otherwise(nxt["display_start"] + inside)
    ).drop("_last", "before", "after")


def mask_filter(frames: DataFrame, ranges: DataFrame, fps: float, on: list[str]) -> DataFrame:
    """Flag frames inside a masked range; every frame stays in the table."""
    ends = ranges.groupBy(*on, "start_sec").agg(F.max("end_sec").alias("end_sec"))
    ends = running(ends, _line(on), _reach=("max", F.col("end_sec")))
    timed = frames.withColumn("_sec", F.col("frame_index") / max(fps, 1e-6))
    out = asof(timed, ends, on, "_sec", "start_sec", ["_reach"])
    masked = F.coalesce(F.col("_sec") < F.col("before._reach"), F.lit(False))
    return out.withColumn("masked", masked).drop("_sec", "before")
