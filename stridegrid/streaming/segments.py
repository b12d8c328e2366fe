"""Tracking per scene segment on a stream, with identities that survive cuts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stridegrid.operators.tracking import CORNERS, SAMPLE_CAP, People, thinned, track_ids, track_ids_of, whole_frames
from stridegrid.plans.session import typed_state
from stridegrid.streaming.identity import TrackTable
from stridegrid.streaming.live import millis

#: Rows of a segment that a task takes from the state at once.
CHUNK = 4096
#: Pairs of boxes that are compared at once.
PAIRS = 1_000_000
_ROW = (
    "frame bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, scene_change boolean, "
    "tab_a double, tab_b double, emb array<double>, ms bigint"
)
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def clear_strips(frame: np.ndarray, det: np.ndarray, boxes: np.ndarray, cover: float = 0.15) -> np.ndarray:
    """Per row of sorted frames whether no other box of its frame covers more than ``cover`` of its leg strip."""
    size = boxes[:, 2:] - boxes[:, :2]
    strip = np.hstack((boxes[:, :2] + size * (0.30, 0.55), boxes[:, :2] + size * (0.70, 0.92)))
    strip[:, 2] = boxes[:, 2] - 0.30 * size[:, 0]
    clear = np.ones(len(boxes), bool)
    whole = np.maximum(1e-6, (strip[:, 2:] - strip[:, :2]).prod(axis=1))
    edges = np.flatnonzero(np.diff(frame, prepend=frame[:1] - 1))
    each = np.diff(edges, append=len(frame))
    # frames side by side, as many as have PAIRS pairs of boxes
    lot = np.cumsum(each * each) // PAIRS
    borders = np.append(np.flatnonzero(np.diff(lot, prepend=-1)), len(edges))
    for low, high in zip(borders[:-1], borders[1:], strict=True):
        a, b, n = edges[low], edges[high - 1] + each[high - 1], each[low:high]
        mates = np.repeat(n, n)
        one = np.repeat(np.arange(a, b), mates)
        two = np.repeat(np.repeat(edges[low:high], n), mates) + np.arange(len(one)) - np.repeat(np.cumsum(mates) - mates, mates)
        apart = det[one] != det[two]
        one, two = one[apart], two[apart]
        sides = np.minimum(strip[one, 2:], boxes[two, 2:]) - np.maximum(strip[one, :2], boxes[two, :2])
        clear[one[np.clip(sides, 0.0, None).prod(axis=1) / whole[one] > cover]] = False
    return clear


def _samples(pdf: pd.DataFrame, local: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(local id, colour) of the rows whose colour counts: leg strip clear, not the frame of a birth."""
    frame, colour = pdf["frame"].to_numpy(), pdf[["tab_a", "tab_b"]].to_numpy(dtype=float)
    used = (local >= 0) & ~np.isnan(colour[:, 0])
    used[used] &= frame[used] != first[local[used]]
    if used.any():
        used &= clear_strips(frame, pdf["det_id"].to_numpy(), pdf[CORNERS].to_numpy(dtype=float))
    return local[used], colour[used]


class SegmentProcessor(StatefulProcessor):
    """State of a video: its place, rows that wait for their turn, rows of the open segment, people.

    Rows wait until their frame is whole; then frames are taken in order. Rows
    of the first segment get their id at once. Those of a later one are kept
    until a cut closes it, as their ids depend on the whole segment; then they
    are tracked chunk by chunk, linked to the people so far and put out. A
    segment that begins and ends in one micro-batch does not go through the
    state; what is known of people is written back once a micro-batch.
    """

    columns = ["video_id", "frame", "det_id", "segment_id", "track_id"]

    def __init__(self, given: list[str], min_surface: int, time: str | None) -> None:
        self.given, self.min_surface, self.time = given, min_surface, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "last bigint, segment bigint, in_cut boolean")
        self.waiting = handle.getListState("waiting", _ROW)
        self.open = handle.getListState("open", _ROW)
        self.book = handle.getValueState("book", "blob binary")
        self.people = handle.getMapState("people", "identity bigint", "frames bigint, seen bigint, colours array<double>")

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=_NAMES)
        return pdf if "emb" in self.given else pdf.drop(columns="emb")

    def _tuples(self, pdf: pd.DataFrame) -> list[tuple]:
        if "emb" not in pdf:
            pdf = pdf.assign(emb=None)
        emb = [None if e is None else list(e) for e in pdf["emb"]]
        return list(zip(*(emb if c == "emb" else pdf[c].tolist() for c in _NAMES), strict=True))

    def _read(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of a micro-batch with the columns of the state."""
        out = {c: pdf[c].astype("int64") for c in ("frame", "det_id")}
        out |= {c: pdf[c].astype(float) if c in pdf else np.nan for c in (*CORNERS, "tab_a", "tab_b")}
        out["scene_change"] = pdf["scene_change"].map(lambda v: v is not None and v == True)  # noqa: E712
        if "emb" in self.given:
            out["emb"] = pdf["emb"]
        out["ms"] = pdf[self.time].map(millis) if self.time else 0
        return pd.DataFrame(out, index=pdf.index)

    def _out(self, key, pdf: pd.DataFrame, segment, ids) -> pd.DataFrame:
        out = pdf[["frame", "det_id"]].reset_index(drop=True)
        out = out.assign(segment_id=pd.Series(segment, index=out.index, dtype="Int64"))
        return out.assign(track_id=pd.Series(ids, index=out.index, dtype="Int64"), video_id=key[0])[self.columns]

    def _ripe(self, pdf: pd.DataFrame, watermark: int) -> np.ndarray:
        """Rows of frames up to the newest that is whole."""
        if self.time is None:
            return (pdf["frame"] < pdf["frame"].max()).to_numpy()
        whole = pdf["ms"].groupby(pdf["frame"]).transform("max") <= watermark
        return (pdf["frame"] <= pdf["frame"].where(whole).max()).to_numpy()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([self._read(p) for p in rows], ignore_index=True)
        if self.place.exists():
            late = new["frame"] <= self.place.get()[0]
            if late.any():
                yield self._out(key, new[late], None, None)
            new = new[~late]
        yield from self._take(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key, None, timerValues)

    def _take(self, key, new: pd.DataFrame | None, timerValues) -> Iterator[pd.DataFrame]:
        held = self._table(list(self.waiting.get())) if self.waiting.exists() else None
        parts = [p for p in (held, new) if p is not None and len(p)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True).sort_values(["frame", "det_id"], kind="stable")
        ripe = self._ripe(pdf, timerValues.getCurrentWatermarkInMs() if self.time else 0)
        left, pdf = pdf[~ripe], pdf[ripe]
        if len(left):
            self.waiting.put(self._tuples(left))
            for at in sorted(set(left["ms"])) if self.time else ():
                self.handle.registerTimer(at)
        else:
            self.waiting.clear()
        if not len(pdf):
            return
        known = self.place.exists()
        _, segment, in_cut = self.place.get() if known else (None, 0, False)
        # what is known of the video: read from the state when asked for, written back once
        self._book = TrackTable() if not known else None
        self._people = (People(self.min_surface), {}) if not known else None
        self._changed: set[int] = set()
        goes_on = known and segment > 0 and not in_cut and self.open.exists()
        cut = pdf.groupby("frame")["scene_change"].transform("max").to_numpy(dtype=bool)
        edges = np.flatnonzero(np.diff(cut, prepend=~cut[:1]))
        stretches = [(a, b, bool(cut[a])) for a, b in zip(edges, [*edges[1:], len(cut)], strict=True)]
        # stretches that need no row of another micro-batch are tracked together
        numbers, before = [], (segment, in_cut)
        for _, _, is_cut in stretches:
            before = (before[0] + (before[1] and not is_cut), is_cut)
            numbers.append(int(before[0]))
        whole = [
            not is_cut and (numbers[i] == 0 or (i + 1 < len(stretches) and not (i == 0 and goes_on)))
            for i, (_, _, is_cut) in enumerate(stretches)
        ]
        tracked = self._tracked(pdf, [(a, b, n) for (a, b, _), n, w in zip(stretches, numbers, whole, strict=True) if w])
        for i, (a, b, is_cut) in enumerate(stretches):
            if is_cut:
                if i == 0:
                    yield from self._closed(key, segment)
                in_cut = True
                continue
            segment, in_cut = numbers[i], False
            ends = i + 1 < len(stretches)
            if segment == 0:
                yield self._live(key, *next(tracked))
                if ends:
                    yield from self._closed(key, 0)
            elif whole[i]:
                rows, ids, book = next(tracked)
                yield self._linked(key, segment, rows.assign(local=ids), *_samples(rows, ids, book.tracks["first"]))
            else:
                self.open.appendList(self._tuples(pdf.iloc[a:b]))
                if ends:
                    yield from self._closed(key, segment)
        if self._book is not None and segment == 0 and not in_cut:
            self.book.update((pickle.dumps(self._book),))
        if self._changed:
            people, seen = self._people
            for g in sorted(self._changed):
                self.people.updateValue((g,), (people.frames_of[g], seen[g], people.colours_of[g].ravel().tolist()))
        self.place.update((int(pdf["frame"].iloc[-1]), int(segment), in_cut))

    def _tracked(self, pdf: pd.DataFrame, stretches: list[tuple]) -> Iterator[tuple[pd.DataFrame, np.ndarray, TrackTable]]:
        """Rows, ids and tracks of stretches of stable frames, each tracked for itself; the first segment goes on with its book."""
        parts = [pdf.iloc[a:b] for a, b, _ in stretches]
        books = [self._live_book() if number == 0 else TrackTable() for _, _, number in stretches]
        if not parts:
            return
        edges = np.cumsum([0, *map(len, parts)])
        rows = pd.concat(parts, ignore_index=True)
        ids = track_ids_of(books, edges, rows.drop(columns="scene_change"))
        for a, b, part, book in zip(edges[:-1], edges[1:], parts, books, strict=True):
            yield part, ids[a:b], book

    def _live_book(self) -> TrackTable:
        if self._book is None:
            self._book = pickle.loads(bytes(self.book.get()[0])) if self.book.exists() else TrackTable()
        return self._book

    def _known(self) -> tuple[People, dict[int, int]]:
        """People of the video, and how many colours of each were seen."""
        if self._people is None:
            people, seen = People(self.min_surface), {}
            for (g,), (frames, n, flat) in sorted((tuple(k), tuple(v)) for k, v in self.people.iterator()):
                people.frames_of[g], seen[g], people.colours_of[g] = frames, n, np.array(flat, float).reshape(-1, 2)
            self._people = people, seen
        return self._people

    def _live(self, key, pdf: pd.DataFrame, ids: np.ndarray, book: TrackTable) -> pd.DataFrame:
        """Rows of the first segment with their ids; its people are its tracks."""
        whose, colours = _samples(pdf, ids, book.tracks["first"])
        people, seen = self._known()
        for g in np.unique(ids[ids >= 0]).tolist():
            kept, own = people.colours_of.get(g, np.empty((0, 2))), colours[whose == g]
            # every 2**k-th sample is kept, as thinning all of them at the end would
            stride, n = 1, seen.get(g, 0)
            while -(-n // stride) > SAMPLE_CAP:
                stride *= 2
            people.colours_of[g] = thinned(np.concatenate((kept, own[(-n) % stride :: stride])))
            people.frames_of[g], seen[g] = people.frames_of.get(g, 0) + int((ids == g).sum()), n + len(own)
            self._changed.add(g)
        return self._out(key, pdf[ids >= 0], 0, ids[ids >= 0])

    def _closed(self, key, segment: int) -> Iterator[pd.DataFrame]:
        """Rows in the state of the segment that a cut ends, with their final ids."""
        if segment == 0:
            self.book.clear()
            return
        if not self.open.exists():
            return
        book, done, whose, colours = TrackTable(), [], [], []

        def chunks() -> Iterator[pd.DataFrame]:
            rows = []
            for row in self.open.get():
                rows.append(row)
                if len(rows) == CHUNK:
                    yield self._table(rows)
                    rows = []
            if rows:
                yield self._table(rows)

        for pdf in whole_frames(chunks()):
            ids = track_ids(book, pdf.drop(columns="scene_change"))
            done.append(pdf[["frame", "det_id"]].assign(local=ids))
            for all_, part in zip((whose, colours), _samples(pdf, ids, book.tracks["first"]), strict=True):
                all_.append(part)
        self.open.clear()
        yield self._linked(key, segment, pd.concat(done), np.concatenate(whose), np.concatenate(colours))

    def _linked(self, key, segment: int, rows: pd.DataFrame, whose: np.ndarray, colours: np.ndarray) -> pd.DataFrame:
        """Rows of a closed segment with the ids of its people; ``rows``: frame, det_id and local id."""
        rows = rows[rows["local"] >= 0]
        local, size = np.unique(rows["local"].to_numpy(), return_counts=True)
        people, seen = self._known()
        people.frames_of, people.colours_of = dict(sorted(people.frames_of.items())), dict(sorted(people.colours_of.items()))
        identity = people.linked(segment, local, size, [colours[whose == i] for i in local])
        for g in set(identity[identity >= 0].tolist()):
            seen[g] = len(people.colours_of[g])
            self._changed.add(g)
        ids = identity[np.searchsorted(local, rows["local"].to_numpy())] if len(rows) else np.zeros(0, np.int64)
        return self._out(key, rows[ids >= 0], segment, ids[ids >= 0])

    def close(self) -> None:
        pass


def segment_stream(
    dets: DataFrame, min_surface: int = 1, time: str | None = None, wait: str = "10 seconds"
) -> DataFrame:
    """(video_id, frame, det_id, segment_id, track_id) of a stream of detections; ids as in ``segmented_tracks``.

    ``dets``: video_id, frame, det_id, corners, scene_change, and optionally emb,
    tab_a, tab_b. A segment after the first comes out when a cut closes it, so
    a row of a cut frame after the last one ends a video (see ``end_rows``). The
    newest frame of a video waits for a later one, so frames may be split over
    micro-batches. With ``time``, a timestamp column, rows may also come in any
    order within ``wait``: they wait until the watermark passes them.

    A null scene_change is no cut. Rows of frames taken before come out with
    nulls in place of segment and id, as an id is never rewritten; rows of cut
    frames and of tracklets too short to be shown do not come out.
    """
    typed_state(dets.sparkSession)
    dets = dets if time is None else dets.withWatermark(time, wait)
    if "emb" in dets.columns:
        dets = dets.withColumn("emb", F.col("emb").cast("array<double>"))
    long = [T.StructField(c, T.LongType()) for c in SegmentProcessor.columns[1:]]
    return dets.groupBy("video_id").transformWithStateInPandas(
        SegmentProcessor(dets.columns, min_surface, time),
        outputStructType=T.StructType([T.StructField("video_id", dets.schema["video_id"].dataType), *long]),
        outputMode="append",
        timeMode="none" if time is None else "eventTime",
    )


def end_rows(dets: DataFrame, time: str | None = None, after: str = "1 day") -> DataFrame:
    """Two rows of cut frames per video of a table, after its last frame: they close its last segment on a stream.

    The first ends the segment; the second lets it go, as the newest frame
    waits. ``time`` is set ``after`` the last of all videos, so that the
    watermark passes the rest.
    """
    last = dets.groupBy("video_id").agg(F.max("frame").alias("_last"))
    rows = last.withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2))))
    own = {"video_id": F.col("video_id"), "frame": F.col("_last") + F.col("_k"), "scene_change": F.lit(True), "det_id": F.lit(0)}
    if time is not None:
        rows = rows.join(F.broadcast(dets.agg((F.max(time) + F.expr(f"INTERVAL {after}")).alias("_end"))))
        own[time] = F.col("_end")
    return rows.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in dets.schema])
