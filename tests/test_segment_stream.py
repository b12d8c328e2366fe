"""Segments on a stream against their table."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridegrid.operators import tracking as TK
from stridegrid.streaming import sinks as K
from stridegrid.streaming.segments import clear_strips, end_rows, segment_stream

COLS = (
    "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, "
    "scene_change boolean, tab_a double, tab_b double, emb array<double>, ts timestamp_ntz"
)


def montage(spark):
    """Three videos of three people, some hidden, some covered, with cuts at different frames (the second starts in one)."""
    rng = np.random.default_rng(4)
    base = np.datetime64("2024-01-01")
    rows = []
    for video, cuts in ((1, [(40, 43), (90, 92)]), (2, [(0, 3), (60, 61)]), (3, [])):
        place = {0: 200.0, 1: 520.0, 2: 860.0}
        for f in range(140):
            cut = any(a <= f < b for a, b in cuts)
            if any(f == b for _, b in cuts):
                place = dict(zip(place, rng.permutation(list(place.values())), strict=True))
            seen = [p for p in place if rng.random() < 0.9]
            for det, p in enumerate(seen):
                x, y = float(place[p] + rng.uniform(-4, 4)), float(200 + rng.uniform(-3, 3))
                emb = np.eye(8)[p] + rng.normal(0, 0.02, 8) if rng.random() < 0.8 else None
                tab = (float(4.0 * p + rng.normal(0, 0.3)), 9.0 * p) if rng.random() < 0.9 else (None, None)
                at = (base + np.timedelta64(f, "s")).astype("datetime64[us]").item()
                rows.append((video, f, det, x, y, x + 80, y + 300, cut, *tab, None if emb is None else emb.tolist(), at))
            if f % 9 == 0:  # a box in front of someone's legs
                x = float(place[1] + 20)
                rows.append((video, f, 7, x, 330.0, x + 70, 520.0, cut, 1.0, 1.0, None, at))
    return spark.createDataFrame(rows, COLS).withColumn("ts", F.col("ts").cast("timestamp"))


def fed(spark, schema, parts, **how):
    """Ids of a stream of parts, each its own run from the checkpoint of the last one."""
    src, ck, out = (tempfile.mkdtemp(prefix="stridegrid-sg-") for _ in range(3))
    sizes = []
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(src)
        got = K.drained(segment_stream(spark.readStream.schema(schema).parquet(src), **how), out + "/out", ck)
        sizes.append(got.count())
    return got, sizes


@pytest.mark.parametrize("least", [1, 45])
def test_split_batches_give_the_ids_of_the_table(spark, least):
    dets = montage(spark).drop("ts").cache()
    want = sorted(map(tuple, TK.segmented_tracks(dets, least).select("video_id", "frame", "det_id", "segment_id", "track_id").collect()))
    part = F.col("frame") * 10 + F.col("det_id")  # borders fall within frames
    parts = [dets.where((part >= a) & (part < b)) for a, b in ((0, 251), (251, 700), (700, 911), (911, 9999))]
    got, sizes = fed(spark, dets.schema, [*parts, end_rows(dets)], min_surface=least)
    assert sorted(map(tuple, got.collect())) == want
    assert len({r[3] for r in want if r[0] == 1}) == 3 and {r[3] for r in want if r[0] == 2} <= {1, 2}
    assert 0 < sizes[0] < sizes[2] < sizes[4]


def test_reordered_rows_wait_for_the_watermark_and_late_ones_stay(spark):
    dets = montage(spark).cache()
    want = sorted(map(tuple, TK.segmented_tracks(dets.drop("ts")).select("video_id", "frame", "det_id", "segment_id", "track_id").collect()))
    f = F.col("frame")
    parts = [dets.where(f < 30), dets.where((f >= 45) & (f < 60)), dets.where((f >= 30) & (f < 45)), dets.where(f >= 60)]
    closing = end_rows(dets, "ts")
    late = dets.where("video_id = 3 AND frame = 5 AND det_id = 0").withColumn("ts", F.expr("ts + INTERVAL 3 DAYS"))
    watch = dets.limit(1).withColumns({"video_id": F.lit(9).cast("long"), "ts": F.expr("timestamp'2024-01-09'")})
    got, _ = fed(spark, dets.schema, [*parts, closing, watch, late], time="ts", wait="40 seconds")
    rows = sorted(map(tuple, got.where("track_id IS NOT NULL AND video_id <> 9").collect()))
    assert rows == want


def test_a_row_of_a_taken_frame_comes_out_without_id(spark):
    dets = montage(spark).drop("ts").where("video_id = 3").cache()
    late = dets.where("frame = 5").withColumn("det_id", F.lit(50).cast("long"))
    got, _ = fed(spark, dets.schema, [dets.where("frame < 20"), late, dets.where("frame >= 20"), end_rows(dets)])
    none = got.where("track_id IS NULL").collect()
    assert none and {r.det_id for r in none} == {50} and got.where("det_id = 50").count() == len(none)
    want = TK.segmented_tracks(dets).select("frame", "det_id", "track_id")
    assert sorted(map(tuple, got.where("det_id <> 50").select("frame", "det_id", "track_id").collect())) == sorted(map(tuple, want.collect()))


def test_strips_are_clear_as_in_the_table(spark):
    from stridegrid.operators.joins import strip_clear

    dets = montage(spark).select("video_id", "frame", "det_id", *TK.CORNERS)
    pdf = dets.where("video_id = 1").orderBy("frame", "det_id").toPandas()
    clear = clear_strips(pdf.frame.to_numpy(), pdf.det_id.to_numpy(), pdf[TK.CORNERS].to_numpy())
    want = {(r.frame, r.det_id) for r in strip_clear(dets.where("video_id = 1")).collect()}
    assert set(zip(pdf.frame[clear], pdf.det_id[clear])) == want and 0 < len(want) < len(pdf)
