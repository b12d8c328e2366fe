"""Streaming forms of the speed-adaptive low-pass and the hand stabiliser, with typed state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stridegrid.operators.hands import CARRIED, INPUTS, Hand, advance_hand, measured, status_of
from stridegrid.operators.recurrences import adaptive_lowpass
from stridegrid.plans.blocks import RUNS, Line
from stridegrid.plans.session import typed_state


class _Ordered(StatefulProcessor):
    """Feeds the rows of a key in order; the state is one typed row, its first column the last position fed.

    Rows at or before that position come too late for it and come out with
    nulls. With ``keep_ms`` the state of a key is dropped after so long without
    a row.
    """

    def __init__(self, line: Line, out: list[str], state: str, keep_ms: int | None) -> None:
        self.key, self.pos = line.keys[0], line.pos
        self.out, self.state, self.keep_ms = out, f"last bigint, {state}", keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slot = handle.getValueState("state", self.state, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.pos, kind="stable")
        last, *state = self.slot.get() if self.slot.exists() else (None,)
        if last is not None and (late := pdf[self.pos] <= last).any():
            yield pdf[late][[self.key, self.pos]].reset_index(drop=True).reindex(columns=[self.key, self.pos, *self.out])
            pdf = pdf[~late]
        if len(pdf):
            pdf = pdf.reset_index(drop=True)
            state, fed = self.feed(tuple(state) if last is not None else None, pdf)
            self.slot.update((int(pdf[self.pos].iloc[-1]), *state))
            yield pd.concat([pdf[[self.key, self.pos]], fed], axis=1)

    def close(self) -> None:
        pass


class _Lowpass(_Ordered):
    def __init__(self, line: Line, dt: float, columns: dict[str, tuple[str, float, float]], keep_ms: int | None) -> None:
        state = ", ".join(f"`{c}` double, `{c}_slope` double" for c in columns)
        super().__init__(line, list(columns), state, keep_ms)
        self.dt, self.columns = dt, columns

    def feed(self, state: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        flat = list(state or [None] * (2 * len(self.columns)))
        out = {}
        for i, (name, (source, floor, beta)) in enumerate(self.columns.items()):
            held = None if flat[2 * i] is None else (flat[2 * i], flat[2 * i + 1])
            series = []
            for v in pdf[source].to_numpy(dtype=float).tolist():
                y = None
                if math.isfinite(v):
                    y, held = adaptive_lowpass(v, held, self.dt, floor, beta)
                series.append(y)
            out[name] = pd.Series(series, dtype=object)
            if held is not None:
                flat[2 * i : 2 * i + 2] = held
        return tuple(flat), pd.DataFrame(out)


def one_euro_stream(
    rows: DataFrame, fps: float, columns: dict[str, tuple[str, float, float]], line: Line = RUNS, keep_ms: int | None = None
) -> DataFrame:
    """(key, position, outputs) of a stream: ``one_euro`` row by row, ``out: (input, min_cutoff, beta)``.

    Positions of a key must come in order over micro-batches; a row at or
    before one that was fed comes out with nulls. ``line`` has one key.
    ``keep_ms`` drops the state of a key after so long without a row, so that
    it starts anew.
    """
    typed_state(rows.sparkSession)
    doubles = [T.StructField(c, T.DoubleType()) for c in columns]
    inputs = list(dict.fromkeys(c for c, _, _ in columns.values()))
    rows = rows.select(*line.keys, line.pos, *inputs)
    return rows.groupBy(*line.keys).transformWithStateInPandas(
        _Lowpass(line, 1.0 / max(1.0, fps), columns, keep_ms),
        outputStructType=T.StructType([*[rows.schema[c] for c in (*line.keys, line.pos)], *doubles]),
        outputMode="append",
        timeMode="none" if keep_ms is None else "processingTime",
    )


class _Hands(_Ordered):
    kept = (
        "box array<double>, start array<double>, missing bigint, turn bigint, "
        "shape array<double>, start_shape array<double>, topology string"
    )

    def __init__(self, line: Line, limits: tuple[float, float], keep_ms: int | None) -> None:
        super().__init__(line, [c.split()[0] for c in CARRIED.split(", ")], self.kept, keep_ms)
        self.limits = limits

    def feed(self, state: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        hand = Hand() if state is None else Hand(*(np.array(v, float) if isinstance(v, list) else v for v in state))
        out = advance_hand(hand, pdf, self.limits)
        values = (getattr(hand, c.split()[0]) for c in self.kept.split(", "))
        return tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in values), out


def hand_stream(frames: DataFrame, width: float, height: float, line: Line = RUNS, keep_ms: int | None = None) -> DataFrame:
    """``hand_temporal`` on a stream; order, late rows and ``keep_ms`` as in ``one_euro_stream``."""
    typed_state(frames.sparkSession)
    keys, pos = list(line.keys), line.pos
    rows = measured(frames, width, height).select(*keys, pos, *INPUTS)
    out = rows.groupBy(*keys).transformWithStateInPandas(
        _Hands(line, (width, height), keep_ms),
        outputStructType=T.StructType([*[rows.schema[c] for c in (*keys, pos)], *T.StructType.fromDDL(CARRIED).fields]),
        outputMode="append",
        timeMode="none" if keep_ms is None else "processingTime",
    )
    status = F.when(F.col("taken").isNotNull(), status_of())
    return out.select(*keys, pos, status.alias("status"), "shape_origin", "missing", "box", "vertices")
