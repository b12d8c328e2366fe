"""Event lists: minimum gaps, alternation, step state, strides."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridegrid.functions.numbers import clip, frames_of
from stridegrid.plans.blocks import RUNS, Line, _in_blocks, neighbourhood, running
from stridegrid.plans.quantiles import exact_quantiles
from stridegrid.plans.session import cut


def _clusters(events: DataFrame, line: Line, gap: int, order: str) -> DataFrame:
    """Number the bursts of events that follow each other within ``gap``.

    After a pause of ``gap`` an event is kept whatever came before, so bursts
    are independent and folds never see more than one burst.
    """
    by_order = Line(line.keys, order, line.block)
    events = cut(events)  # event-sized, read again by both scans
    out = running(events, by_order, _before=("prev", F.col(line.pos)))
    starts = F.col("_before").isNull() | (F.col(line.pos) - F.col("_before") >= gap)
    return running(
        out.withColumn("_starts", starts.cast("int")), by_order, _burst=("sum", F.col("_starts"))
    ).drop("_before", "_starts")


def _fold(events: DataFrame, keys: list[str], row: Column, gap: int, higher: bool = False) -> DataFrame:
    """Rows of each burst, in order, that stand at least ``gap`` after the last kept one.

    ``row`` is a struct with the position ``p``; with ``higher`` a row too near
    replaces the last kept one if its ``h`` is greater (null never, NaN most). A
    burst streams through a task that holds its last kept row, so its time goes
    by its length, however long it is.
    """
    unit = [*keys, "_burst"]
    rows = _in_blocks(events.select(*unit, row.alias("_kept")), unit, "_kept")
    told = ["_kept.p", "_kept.h"] if higher else ["_kept.p"]
    rows = rows.select(*keys, "_kept", "_first", *[F.col(c).alias(c[-1]) for c in told])
    schema = T.StructType([rows.schema[c] for c in (*keys, "_kept")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, top = None, None, None  # the last kept row of a batch before, its position and height
        for batch in batches:
            own = batch.select(schema.names)
            at, done = -1, []  # the last kept row in this batch, and those nothing can replace any more
            fresh, place = batch.column("_first").to_pylist(), batch.column("p").to_pylist()
            height = batch.column("h").to_pylist() if higher else place
            for i, (new, p, h) in enumerate(zip(fresh, place, height, strict=True)):
                if new or (p is not None and last is not None and p - last >= gap):
                    if at >= 0:
                        done.append(at)
                    elif held is not None:
                        yield held
                elif not (higher and h is not None and top is not None and (h > top or (h != h and top == top))):
                    continue
                held, at, last, top = None, i, p, h
            yield own.take(pa.array(done, pa.int64()))
            held = own.slice(at, 1) if at >= 0 else held
        if held is not None:
            yield held

    return rows.mapInArrow(run, schema)


def min_gap_peaks(events: DataFrame, gap: int, height: str = "lift", line: Line = RUNS) -> DataFrame:
    """Peaks at least ``gap`` apart; a higher one replaces the kept one before it."""
    bursts = _clusters(events, line, gap, line.pos)
    row = F.struct(F.col(line.pos).alias("p"), F.col(height).alias("h"))

    keys = list(line.keys)
    return _fold(bursts, keys, row, gap, higher=True).select(
        *keys, F.col("_kept.p").alias(line.pos), F.col("_kept.h").alias(height)
    )


def spaced_events(
    events: DataFrame, gap: int, line: Line = RUNS, order: str | None = None, extra: tuple = ()
) -> DataFrame:
    """Events at least ``gap`` after the last kept one; ``extra`` columns ride along."""
    order = order or line.pos
    bursts = _clusters(events, line, gap, order)
    row = F.struct(
        F.col(order).alias("o"), F.col(line.pos).alias("p"), *[F.col(c) for c in extra]
    )

    keys = list(line.keys)
    return _fold(bursts, keys, row, gap).select(
        *keys,
        F.col("_kept.o").alias("_order"),
        F.col("_kept.p").alias(line.pos),
        *[F.col(f"_kept.{c}").alias(c) for c in extra],
    )


def refractory_events(
    left: DataFrame, right: DataFrame, fps: float, line: Line = RUNS
) -> DataFrame:
    """Merge both sides, drop events inside the refractory time, flag alternation."""
    keys = list(line.keys)
    both = (
        left.select(*keys, line.pos)
        .withColumn("side", F.lit("left"))
        .unionByName(right.select(*keys, line.pos).withColumn("side", F.lit("right")))
    )
    both = both.withColumn(
        "_ord", F.col(line.pos) * 2 + F.when(F.col("side") == "left", 0).otherwise(1)
    )
    gap = frames_of(0.22, max(fps, 1.0), 1)
    kept = cut(spaced_events(both, gap, line, "_ord", ("side",)))
    kept = running(kept, Line(line.keys, "_order", line.block), _was=("prev", F.col("side")))
    return kept.select(
        *keys,
        line.pos,
        "side",
        (F.col("_was").isNull() | (F.col("side") != F.col("_was"))).alias("alternates"),
    )


def gap_limited_edges(edges: DataFrame, gap: int, line: Line = RUNS) -> DataFrame:
    """Per side and kind, edges at least ``gap`` after the last kept one."""
    keyed = Line((*line.keys, "side", "type"), line.pos, line.block)
    return spaced_events(edges, gap, keyed).drop("_order")


def expected_step_interval(events: DataFrame, fps: float, line: Line = RUNS) -> DataFrame:
    """Typical interval of alternating events, 0.45 to 1.60 s, per run."""
    keys = list(line.keys)
    alt = events.where("alternates")
    alt = running(alt, line, _before=("prev", F.col(line.pos)))
    gaps = alt.withColumn("_s", (F.col(line.pos) - F.col("_before")) / max(fps, 1e-6))
    ok = gaps.where((F.col("_s") >= 0.20) & (F.col("_s") <= 2.50))
    q = exact_quantiles(ok, keys, "_s", {"_q": 0.65})
    runs = events.select(*keys).distinct()
    return runs.join(q, keys, "left").select(
        *keys,
        clip(F.coalesce("_q", F.lit(0.85)), 0.45, 1.60).alias("expected_interval_s"),
    )


def step_state(frames: DataFrame, events: DataFrame, fps: float, line: Line = RUNS) -> DataFrame:
    """Per frame: step event, cadence and time since the last alternating step."""
    keys = list(line.keys)
    rate = max(fps, 1e-6)
    alt = running(events.where("alternates"), line, _before=("prev", F.col(line.pos)))
    alt = alt.select(
        *keys,
        line.pos,
        F.lit(True).alias("_alt"),
        (rate / (F.col(line.pos) - F.col("_before"))).alias("_cad"),
    )
    out = frames.join(alt, [*keys, line.pos], "left")
    out = running(
        out,
        line,
        cadence_hz=("last", F.col("_cad")),
        _step=("last", F.when(F.col("_alt"), F.col(line.pos))),
    )
    return out.withColumns(
        {
            "effective_event": F.when(F.col("_alt"), 1.0).otherwise(0.0),
            "since_step_s": F.coalesce((F.col(line.pos) - F.col("_step")) / rate, F.lit(0.0)),
        }
    ).drop("_alt", "_cad", "_step")


def strides(events: DataFrame, fps: float, line: Line = RUNS) -> DataFrame:
    """Consecutive heel strikes of the same side: start and end frame, duration."""
    side = Line((*line.keys, "side"), line.pos, line.block)
    hs = events.where(F.col("type") == "heel_strike")
    nxt = running(hs, side, end_frame=("after", F.col(line.pos)))
    return nxt.where(F.col("end_frame").isNotNull()).select(
        *line.keys,
        "side",
        F.col(line.pos).alias("start_frame"),
        "end_frame",
        ((F.col("end_frame") - F.col(line.pos)) / max(fps, 1e-6)).alias("duration_s"),
    )


def steps(events: DataFrame, fps: float, line: Line = RUNS) -> DataFrame:
    """Consecutive heel strikes of any side where the sides differ."""
    keys = list(line.keys)
    hs = events.where(F.col("type") == "heel_strike").withColumn(
        "_ord", F.col(line.pos) * 2 + F.when(F.col("side") == "left", 0).otherwise(1)
    )
    order = Line(line.keys, "_ord", line.block)
    nxt = running(
        hs, order, _next=("after", F.struct(F.col(line.pos).alias("p"), F.col("side").alias("s")))
    )
    return nxt.where(F.col("_next.s") != F.col("side")).select(
        *keys,
        "side",
        F.col("_next.s").alias("end_side"),
        F.col(line.pos).alias("start_frame"),
        F.col("_next.p").alias("end_frame"),
        ((F.col("_next.p") - F.col(line.pos)) / max(fps, 1e-6)).alias("duration_s"),
    )
