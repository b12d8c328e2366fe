"""Prompt anchors for a live stream of frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stridegrid.plans.session import typed_state


class _Cursor(StatefulProcessor):
    """Gives each frame the number of the newest anchor since the frame before it; the state is the last frame served."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = T.StructType([T.StructField("frame", T.LongType())])
        self.slot = handle.getValueState("cursor", kind, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("frame_index", kind="stable")
        held = pdf["anchors_of_run"].iloc[0]
        at = np.sort(np.zeros(0, np.int64) if held is None else np.asarray(held, np.int64))
        before = int(self.slot.get()[0]) if self.slot.exists() else -(2**62)
        found = []
        for frame in pdf["frame_index"].tolist():
            i = int(np.searchsorted(at, frame, side="right")) - 1
            found.append(int(at[i]) if i >= 0 and at[i] > before else None)
            before = max(before, frame)
        self.slot.update((before,))
        out = pdf[["run_id", "frame_index"]].reset_index(drop=True)
        yield out.assign(anchor_at=pd.Series(found, dtype="Int64"))

    def close(self) -> None:
        pass


def anchor_stream(frames: DataFrame, anchors: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(run_id, frame_index, payload): frames of a stream with the anchor each is the first to reach.

    ``anchors`` is a table: run_id, frame_index and payload columns. As in the
    batch ``anchor_feed``, an anchor goes to the first frame at or after its
    own, once, and the newest of several wins. A frame that comes after a later
    one gets none. The state is one number per run; with ``keep_ms`` it is
    dropped after so long without a frame, which needs that no older frame
    follows. Only the frame numbers of a run's anchors go through the state; what
    they carry is joined to the result.
    """
    typed_state(frames.sparkSession)
    payload = [c for c in anchors.columns if c not in ("run_id", "frame_index")]
    once = anchors.groupBy("run_id", F.col("frame_index").cast("long").alias("anchor_at"))
    once = once.agg(F.max(F.struct(*payload)).alias("anchor_row"))
    held = once.groupBy("run_id").agg(F.collect_list("anchor_at").alias("anchors_of_run"))
    rows = frames.select("run_id", F.col("frame_index").cast("long").alias("frame_index")).join(held, "run_id", "left")
    kinds = [frames.schema["run_id"].dataType, T.LongType(), T.LongType()]
    served = rows.groupBy("run_id").transformWithStateInPandas(
        _Cursor(keep_ms),
        outputStructType=T.StructType([T.StructField(c, k) for c, k in zip(("run_id", "frame_index", "anchor_at"), kinds)]),
        outputMode="append",
        timeMode="none" if keep_ms is None else "processingTime",
    )
    return served.join(once, ["run_id", "anchor_at"], "left").select("run_id", "frame_index", "anchor_row.*")
