"""Structured Streaming forms of the tracking operators."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stridegrid.operators.locks import OUT, advance_rows, lock_evidence
from stridegrid.operators.tracking import track_ids
from stridegrid.plans.session import typed_state
from stridegrid.streaming.identity import TrackTable


def millis(at) -> int:
    """A time as milliseconds, rounded up; a row without time waits for nothing."""
    return 0 if pd.isna(at) else -(-pd.Timestamp(at).value // 1_000_000)


class _Kept(StatefulProcessor):
    """Keeps one pickled state per key; rows are fed in frame order.

    With ``time`` all rows wait in the state, in any order, until the watermark
    passes them; then frames up to the newest one it has passed are closed in
    frame order, by an event-time timer where no further row comes.
    With ``split_frames`` the newest frame stays open: its rows are kept in the
    state until a later frame arrives, so a frame may be split over
    micro-batches; a last row of a later frame closes a video.
    Without either, a micro-batch must hold whole frames. Rows of frames that
    are closed come too late: an id is never rewritten, so they are put out
    with nulls.
    """

    frame = "frame"

    def __init__(self, split_frames: bool = False, time: str | None = None):
        self.split_frames, self.time = split_frames, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slot = handle.getValueState("state", T.StructType([T.StructField("blob", T.BinaryType())]))

    def _load(self):
        """The last closed frame, rows of the open one, the state."""
        return pickle.loads(bytes(self.slot.get()[0])) if self.slot.exists() else (None, None, None)

    def _close(self, last, state, rows: pd.DataFrame, open_rows: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        late = rows[self.frame] <= last if last is not None else pd.Series(False, index=rows.index)
        out = [rows[late][self.names].reset_index(drop=True)] if late.any() else []
        rows = rows[~late]
        if len(rows):
            state, fed = self.feed(state, rows.reset_index(drop=True))
            out.append(fed)
            last = int(rows[self.frame].max())
        self.slot.update((pickle.dumps((last, open_rows, state)),))
        for part in out:
            yield part.reindex(columns=self.columns)

    def _ripe(self, pdf: pd.DataFrame, watermark: int) -> pd.Series:
        """Rows of frames up to the newest that the watermark has passed."""
        ms = pdf[self.time].map(millis)
        newest = pdf[self.frame].where(ms.groupby(pdf[self.frame]).transform("max") <= watermark).max()
        return pdf[self.frame] <= newest

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, open_rows, state = self._load()
        parts = [p for p in (open_rows, *rows) if p is not None and len(p)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True).sort_values(self.order, kind="stable")
        open_rows = None
        if self.time is not None:
            ripe = self._ripe(pdf, timerValues.getCurrentWatermarkInMs())
            if last is not None:
                ripe |= pdf[self.frame] <= last
            pdf, open_rows = pdf[ripe], pdf[~ripe]
            for at in sorted(set(open_rows[self.time].map(millis))):
                self.handle.registerTimer(at)
        elif self.split_frames:
            newest = pdf[self.frame] == pdf[self.frame].max()
            if last is not None:
                newest &= pdf[self.frame] > last
            pdf, open_rows = pdf[~newest], pdf[newest]
        yield from self._close(last, state, pdf, open_rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, open_rows, state = self._load()
        if open_rows is None or not len(open_rows):
            return
        ripe = self._ripe(open_rows, timerValues.getCurrentWatermarkInMs())
        if ripe.any():
            yield from self._close(last, state, open_rows[ripe], open_rows[~ripe])

    def close(self) -> None:
        pass


class TrackProcessor(_Kept):
    order = ["frame", "det_id"]
    names = ["video_id", "frame", "det_id"]
    columns = [*names, "track_id"]

    def feed(self, book: TrackTable | None, pdf: pd.DataFrame):
        book = TrackTable() if book is None else book
        return book, pdf[self.names].assign(track_id=track_ids(book, pdf))


class LockProcessor(_Kept):
    frame = "frame_index"
    order = ["frame_index"]
    names = ["run_id", "frame_index"]
    columns = [*names, *OUT.names]

    def __init__(self, width: float, height: float, split_frames: bool = False, time: str | None = None):
        super().__init__(split_frames, time)
        self.width, self.height = width, height

    def feed(self, lock, pdf: pd.DataFrame):
        lock, out = advance_rows(lock, pdf, self.width, self.height)
        return lock, pd.concat([pdf[self.names], out], axis=1)


def track_stream(
    dets: DataFrame, split_frames: bool = False, time: str | None = None, wait: str = "10 seconds"
) -> DataFrame:
    """Live ids; ``dets``: video_id, frame, det_id, corners, optional emb, scene_change.

    With ``time``, a timestamp column, frames may be split and come in any order
    within ``wait``, and the last frame is closed by the watermark. Without, a
    micro-batch holds any number of whole frames of a video, or with
    ``split_frames`` a frame may be split (see ``_Kept``).
    """
    typed_state(dets.sparkSession)
    dets = dets if time is None else dets.withWatermark(time, wait)
    schema = "video_id long, frame long, det_id long, track_id long"
    return dets.groupBy("video_id").transformWithStateInPandas(
        TrackProcessor(split_frames, time),
        outputStructType=schema,
        outputMode="append",
        timeMode="none" if time is None else "eventTime",
    )


def lock_stream(
    frames: DataFrame, width: float, height: float, split_frames: bool = False,
    time: str | None = None, wait: str = "10 seconds",
) -> DataFrame:
    """Live lock; columns as in the batch operator, ``time`` and ``wait`` as in ``track_stream``."""
    typed_state(frames.sparkSession)
    frames = frames if time is None else frames.withWatermark(time, wait)
    schema = T.StructType(
        [T.StructField("run_id", T.LongType()), T.StructField("frame_index", T.LongType()), *OUT.fields]
    )
    return lock_evidence(frames, width, height).groupBy("run_id").transformWithStateInPandas(
        LockProcessor(width, height, split_frames, time),
        outputStructType=schema,
        outputMode="append",
        timeMode="none" if time is None else "eventTime",
    )


def late_frames(stream: DataFrame, keys: list[str], time: str = "ts", wait: str = "10 seconds") -> DataFrame:
    """Frames within the watermark, each once."""
    return stream.withWatermark(time, wait).dropDuplicatesWithinWatermark(keys)


def windowed_counts(
    df: DataFrame, keys: list[str], time: str = "ts", width: str = "1 hour", slide: str | None = None, wait: str | None = None
) -> DataFrame:
    """Rows per window and key, tumbling or sliding, of a table or a stream.

    A stream needs ``wait``: rows later than the watermark are left out, and a
    window comes out once the watermark has passed its end.
    """
    df = df if wait is None else df.withWatermark(time, wait)
    win = F.window(time, width, slide) if slide else F.window(time, width)
    counted = df.groupBy(win.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("window_start"), "n")


def absence_sessions(
    df: DataFrame, keys: list[str], time: str = "ts", gap: str = "10 minutes", wait: str | None = None
) -> DataFrame:
    """Spans of sightings separated by pauses of at least ``gap``; ``wait`` as in ``windowed_counts``."""
    df = df if wait is None else df.withWatermark(time, wait)
    win = F.session_window(time, gap)
    counted = df.groupBy(win.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last_seen"))
    return counted.select(*keys, F.col("w.start").alias("first_seen"), "last_seen", "n")


def live_metrics(records: DataFrame, path: str, checkpoint: str, key: str = "run_id", at: str = "frame_index"):
    """Write the counts of each micro-batch per key; returns the running query.

    Every epoch has a folder of its own that a replay overwrites, so no row
    counts twice. ``live_totals`` adds the epochs up.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        counts = batch.groupBy(key).agg(
            F.count(F.lit(1)).alias("frames"),
            F.max(at).alias("last"),
            F.sum(F.col("present").cast("long")).alias("present"),
        )
        counts.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        records.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_totals(counts: DataFrame, key: str = "run_id", every: int = 10) -> DataFrame:
    """Progress of each key so far from the counts of all epochs."""
    return counts.groupBy(key).agg(
        F.sum("frames").alias("frames"),
        (F.floor((F.max("last") + 1) / every) * every).alias("reported_to"),
        F.sum("present").alias("present"),
    )


def progress(df: DataFrame, key: str, every: int, at: str = "frame_index") -> DataFrame:
    """Counts of all rows per key, and the last multiple of ``every`` frames they reach."""
    last = F.floor((F.max(at) + 1) / every) * every
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("frames"), last.alias("reported_to"),
        F.sum(F.col("present").cast("long")).alias("present"),
    )


def write_lines(stream: DataFrame, path: str, checkpoint: str):
    """Append final detection rows as JSON lines; returns the running query."""
    return (
        stream.writeStream.format("json")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
