"""Best paths along timelines as products of max-plus matrices.

A path gains ``gain`` at every state and pays ``cost`` between the states of
adjacent frames. The best score from the states of one frame to those of a later
one is a matrix product with max for sum and sum for product, so blocks of a
timeline are multiplied apart, their products are chained, and every block then
knows the scores it starts from. No block guesses its start.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridegrid.plans.blocks import Line, _with_halo, for_python
from stridegrid.plans.session import cut

Cost = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Frames:
    """States of consecutive frames, padded to one width; the last state is always there.

    ``x``, ``y``, ``gain``: (frames, width); padding has a gain of minus
    infinity. ``size``: states of each frame without the last one.
    """

    x: np.ndarray
    y: np.ndarray
    gain: np.ndarray
    size: np.ndarray
    cost: Cost

    @classmethod
    def of(cls, x: list, y: list, gain: list, cost: Cost) -> Frames:
        size = np.array([len(v) for v in x], np.int64)
        flat = [np.concatenate([np.asarray(p, dtype=float) for p in parts]) if size.sum() else np.zeros(0) for parts in (x, y, gain)]
        return cls.flat(size, *flat, cost)

    @classmethod
    def flat(cls, size: np.ndarray, x: np.ndarray, y: np.ndarray, gain: np.ndarray, cost: Cost) -> Frames:
        """From the states of all frames one after another; a missing gain is not a number."""
        n, width = len(size), int(size.max(initial=0)) + 1
        row = np.repeat(np.arange(n), size)
        col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        held = [np.zeros((n, width)), np.zeros((n, width)), np.full((n, width), -np.inf)]
        for to, values in zip(held, (x, y, np.where(np.isnan(gain), -np.inf, gain))):
            to[row, col] = values
        held[2][:, -1] = 0.0
        return cls(*held, size, cost)

    def steps(self, at: np.ndarray) -> np.ndarray:
        """Score of going from each state of frame ``at`` to each of the next: (., width, width)."""
        cost = self.cost(self.x[at], self.y[at], self.x[at + 1], self.y[at + 1])
        return self.gain[at + 1][:, None, :] - cost

    def lanes(self) -> list[np.ndarray]:
        """Steps cut into lanes that run side by side: the steps taken together, lane by lane in order."""
        m = len(self.size) - 1
        length = max(1, math.isqrt(max(m, 1)))
        starts = np.arange(0, m, length)
        return [starts[starts + s < m] + s for s in range(length)] if m > 0 else []

    def packed(self, scores: np.ndarray, frame: int) -> np.ndarray:
        """Scores of the states of one frame without padding."""
        return np.append(scores[..., : self.size[frame]], scores[..., -1:], axis=-1)

    def padded(self, scores: np.ndarray, frame: int) -> np.ndarray:
        out = np.full(self.x.shape[1], -np.inf)
        out[: self.size[frame]], out[-1] = scores[:-1], scores[-1]
        return out


def _lane_products(frames: Frames) -> np.ndarray:
    """Max-plus product of the steps of each lane: (lanes, width, width)."""
    width = frames.x.shape[1]
    steps = frames.lanes()
    out = np.full((len(steps[0]) if steps else 0, width, width), -np.inf)
    out[:, np.arange(width), np.arange(width)] = 0.0
    for at in steps:
        step = frames.steps(at)
        k = len(at)
        for i in range(width):
            out[:k, i] = (out[:k, i, :, None] + step).max(axis=1)
    return out


def product(frames: Frames) -> np.ndarray:
    """Best score from every state of the first frame to every state of the last."""
    width = frames.x.shape[1]
    out = np.where(np.eye(width, dtype=bool), 0.0, -np.inf)
    for lane in _lane_products(frames):
        out = (out[:, :, None] + lane[None]).max(axis=1)
    return out


def forward(frames: Frames, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores at the last frame and, per step, the state each state is best reached from (first of ties)."""
    width = frames.x.shape[1]
    back = np.zeros((max(0, len(frames.size) - 1), width), np.int32)
    scores, v = [], start
    for lane in _lane_products(frames):
        scores.append(v)
        v = (v[:, None] + lane).max(axis=0)
    held = np.array(scores).reshape(len(scores), width)
    for at in frames.lanes():
        k = len(at)
        total = held[:k, :, None] + frames.steps(at)
        back[at] = total.argmax(axis=1)
        held[:k] = np.take_along_axis(total, back[at][:, None, :], axis=1)[:, 0]
    return (held[-1] if len(held) else start), back


def entries(frames: Frames, back: np.ndarray) -> np.ndarray:
    """For every state of the last frame the state of the first frame its best path comes from."""
    now = np.arange(frames.x.shape[1])
    for lane in _lane_entries(frames, back)[::-1]:
        now = lane[now]
    return now


def _lane_entries(frames: Frames, back: np.ndarray) -> np.ndarray:
    steps = frames.lanes()
    width = frames.x.shape[1]
    out = np.tile(np.arange(width), (len(steps[0]) if steps else 0, 1))
    for at in steps[::-1]:
        out[: len(at)] = np.take_along_axis(back[at], out[: len(at)], axis=1)
    return out


def picks(frames: Frames, back: np.ndarray, last: int) -> np.ndarray:
    """The state of every frame on the best path that ends in ``last``."""
    out = np.empty(len(frames.size), np.int64)
    out[-1] = last
    lanes = _lane_entries(frames, back)
    ends = np.empty(len(lanes), np.int64)
    now = last
    for i in range(len(lanes) - 1, -1, -1):
        ends[i] = now
        now = lanes[i][now]
    for at in frames.lanes()[::-1]:
        k = len(at)
        ends[:k] = back[at, ends[:k]]
        out[at] = ends[:k]
    return out


_VECTOR = T.ArrayType(T.DoubleType())


def best_paths(frames: DataFrame, line: Line, x: str, y: str, gain: str, cost: Cost, out: str) -> DataFrame:
    """(keys, position, ``out``): per frame the number of the chosen state, the size of the lists for the last state.

    ``frames``, which is read several times, has arrays ``x``, ``y`` and ``gain`` of the states of a frame on a
    dense position; a state of null gain is never taken, and the last state,
    with gain 0, is implied. Ties go to the smaller number at every step, as in
    one pass over the whole timeline. A timeline of one block knows its start and
    is solved in one call; blocks of longer ones also read the last frame of the
    block before.
    """
    keys, pos = list(line.keys), line.pos
    source = frames.select(*keys, pos, x, y, gain)
    pick_schema = T.StructType([*(source.schema[k] for k in keys), source.schema[pos], T.StructField(out, T.IntegerType())])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        lists = [table.column(c).combine_chunks() for c in (x, y, gain)]
        size = lists[0].value_lengths().to_numpy().astype(np.int64)
        own = Frames.flat(size, *(v.flatten().to_numpy(zero_copy_only=False).astype(float) for v in lists), cost)
        score, back = forward(own, own.gain[0])
        path = np.minimum(picks(own, back, _padded_state(own, int(own.packed(score, -1).argmax()))), own.size)
        return table.select([*keys, pos]).append_column(out, pa.array(path.astype(np.int32)))

    longer = cut(source.groupBy(*keys).agg(F.max(pos).alias("_top")).where(F.col("_top") >= line.block).select(*keys))
    within = lambda df: for_python(df, *keys).groupBy(*keys).applyInArrow(whole, pick_schema)
    if longer.isEmpty():
        return within(source)
    return within(source.join(longer, keys, "left_anti")).unionByName(
        _best_of_blocks(source.join(longer, keys, "left_semi"), line, x, y, gain, cost, out, pick_schema)
    )


def _padded_state(frames: Frames, state: int) -> int:
    """The number of a state of the last frame with padding."""
    return frames.x.shape[1] - 1 if state == frames.size[-1] else state


def _best_of_blocks(
    source: DataFrame, line: Line, x: str, y: str, gain: str, cost: Cost, out: str, pick_schema: T.StructType
) -> DataFrame:
    """``best_paths`` of timelines of several blocks."""
    keys, pos = list(line.keys), line.pos
    blocks = lambda df: for_python(_with_halo(df, line, 1, 0), *keys, "_blk")
    key_fields = [source.schema[k] for k in keys]
    per_block = [*key_fields, T.StructField("_blk", T.LongType())]

    def held(pdf: pd.DataFrame) -> tuple[pd.DataFrame, Frames, bool]:
        pdf = pdf.sort_values(pos)
        return pdf, Frames.of(list(pdf[x]), list(pdf[y]), list(pdf[gain]), cost), bool(pdf["_home"].iloc[0] < pdf["_blk"].iloc[0])

    def alone(pdf: pd.DataFrame) -> bool:
        return not (pdf["_home"] == pdf["_blk"]).any()

    def nothing(schema: T.StructType) -> pd.DataFrame:
        return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema})

    product_schema = T.StructType([*per_block, T.StructField("_m", _VECTOR), T.StructField("_rows", T.LongType())])
    trace_schema = T.StructType(
        [*per_block, T.StructField("_entry", T.ArrayType(T.LongType())), T.StructField("_best", T.LongType())]
    )

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        if alone(pdf):
            return nothing(product_schema)
        pdf, own, led = held(pdf)
        m = own.packed(product(own), -1)
        m = own.packed(m.T, 0).T if led else (own.gain[0][:, None] + m).max(axis=0)[None]
        row = pdf.iloc[:1][[*keys, "_blk"]]
        return row.assign(_m=[np.where(np.isneginf(m), -1e300, m).ravel().tolist()], _rows=[len(m)])

    products = blocks(source).groupBy(*keys, "_blk").applyInPandas(multiply, product_schema)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        v, starts = None, []
        for m, rows in zip(pdf["_m"], pdf["_rows"]):
            starts.append(None if v is None else v.tolist())
            m = np.asarray(m, dtype=float).reshape(int(rows), -1)
            v = m[0] if v is None else (v[:, None] + m).max(axis=0)
            v = v - v.max()
        return pdf[[*keys, "_blk"]].assign(_start=starts)

    starts = cut(products.groupBy(*keys).applyInPandas(chain, T.StructType([*per_block, T.StructField("_start", _VECTOR)])))

    def solved(pdf: pd.DataFrame) -> tuple[pd.DataFrame, Frames, bool, np.ndarray, np.ndarray]:
        pdf, own, led = held(pdf)
        given = pdf["_start"].iloc[0]
        return pdf, own, led, *forward(own, own.padded(np.asarray(given, dtype=float), 0) if led else own.gain[0])

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        if alone(pdf):
            return nothing(trace_schema)
        pdf, own, led, score, back = solved(pdf)
        entry = own.packed(entries(own, back), -1)
        entry = np.minimum(entry, own.size[0])  # the last state by its number without padding
        best = int(own.packed(score, -1).argmax())
        return pdf.iloc[:1][[*keys, "_blk"]].assign(_entry=[entry.tolist()], _best=[best])

    ready = lambda: blocks(source).join(starts, [*keys, "_blk"]).groupBy(*keys, "_blk")
    maps = ready().applyInPandas(trace, trace_schema)

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        now, ends = int(pdf["_best"].iloc[-1]), []
        for entry in pdf["_entry"].iloc[::-1]:
            ends.append(now)
            now = int(entry[now])
        return pdf[[*keys, "_blk"]].assign(_end=ends[::-1])

    ends = cut(maps.groupBy(*keys).applyInPandas(turn, T.StructType([*per_block, T.StructField("_end", T.LongType())])))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        if alone(pdf):
            return nothing(pick_schema)
        pdf, own, led, _, back = solved(pdf)
        path = np.minimum(picks(own, back, _padded_state(own, int(pdf["_end"].iloc[0]))), own.size)
        return pdf[[*keys, pos]].assign(**{out: path}).iloc[int(led) :]

    return (
        blocks(source).join(starts, [*keys, "_blk"]).join(ends, [*keys, "_blk"])
        .groupBy(*keys, "_blk").applyInPandas(pick, pick_schema)
    )
