"""Windows, snapshots, progress and anchors on streams against their tables."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stridegrid.operators.locks import anchor_feed
from stridegrid.streaming import live as L
from stridegrid.streaming import sinks as K
from stridegrid.streaming.anchors import anchor_stream

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def folder(spark, schema, *batches):
    """A stream that takes one file of rows per micro-batch, in this order."""
    path = tempfile.mkdtemp(prefix="stridegrid-src-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    files = [f"{path}/part={i}" for i in range(len(batches))]
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return source.parquet(f"{path}/part=*"), spark.read.schema(schema).parquet(*files)


def new(name="out"):
    return f"{tempfile.mkdtemp(prefix='stridegrid-t-')}/{name}"


SCHEMA = "run_id bigint, ts timestamp"
BATCHES = [
    [(1, at(m)) for m in (1, 5, 20)] + [(2, at(3))],
    [(1, at(90)), (2, at(95))],
    [(2, at(96))],  # a watermark takes rows from the batch after the next on
    [(1, at(70)), (1, at(2)), (2, at(300))],  # 70 is within the watermark of 95 - 30, 2 is beyond it
    [(None, at(3000))],
]


@pytest.mark.parametrize("sessions", [False, True])
def test_late_rows_count_until_the_watermark(spark, sessions):
    stream, table = folder(spark, SCHEMA, *BATCHES)
    kept = table.where((F.col("run_id").isNotNull()) & ~((F.col("run_id") == 1) & (F.col("ts") == F.lit(at(2)))))
    call = (lambda d, **k: L.absence_sessions(d, ["run_id"], gap="30 minutes", **k)) if sessions else (
        lambda d, **k: L.windowed_counts(d, ["run_id"], width="1 hour", slide="30 minutes", **k)
    )
    got = K.drained(call(stream, wait="30 minutes"), new(), new())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, call(kept).collect()))


def test_a_close_row_brings_all_windows_out(spark):
    stream, table = folder(spark, SCHEMA, BATCHES[0], BATCHES[1])
    path = new("close")
    K.write_close(table, path, "ts", "1 day")
    got = K.drained(L.windowed_counts(K.with_close(stream, path), ["run_id"], wait="10 minutes"), new(), new())
    want = L.windowed_counts(table, ["run_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    K.write_close(table.limit(0), path + "-none", "ts", "1 day")
    assert spark.read.parquet(path + "-none").count() == 0


def test_snapshot_is_the_same_after_a_replayed_epoch(spark):
    schema = "video_id bigint, track_id bigint, frame bigint, score double"
    one = [(1, 7, f, f / 10) for f in range(5)] + [(1, 8, 2, 0.5)]
    stream, table = folder(spark, schema, one, [(1, 7, 9, 0.9), (2, 7, 0, 0.1)])
    path, keys = new("tracks"), ["video_id", "track_id"]
    K.write_snapshots(stream, keys, "frame", path, new()).awaitTermination()
    read = lambda: sorted(map(tuple, K.snapshot(spark.read.parquet(path), keys, "frame").collect()))
    want = [(1, 7, 6, 0, 9, 0.9), (1, 8, 1, 2, 2, 0.5), (2, 7, 1, 0, 0, 0.1)]
    assert read() == want
    K.write_snapshots(stream, keys, "frame", path, new()).awaitTermination()  # a lost checkpoint: all epochs again
    assert read() == want


def test_progress_rows_add_up(spark):
    rows = K.ProgressRows()
    spark.streams.addListener(rows)
    try:
        stream, table = folder(spark, SCHEMA, *BATCHES)
        K.drained(L.windowed_counts(stream, ["run_id"], wait="30 minutes"), new(), new()).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(50):
            if sum(r[2] for r in rows.rows) >= table.count():
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(rows)
    told = spark.createDataFrame(rows.rows, K.ProgressRows.schema)
    assert told.agg(F.sum("input_rows"), F.sum("late_rows")).first() == (table.count(), 1)


def test_anchor_stream_equals_anchor_feed_over_batches_and_restarts(spark):
    frames = [[(1, f) for f in range(0, 10, 2)] + [(2, 5)], [(1, f) for f in range(10, 30, 3)], [(1, 40), (2, 6), (3, 1)]]
    anchors = spark.createDataFrame(
        [(1, 0, [1.0]), (1, 3, [2.0]), (1, 4, [3.0]), (1, 9, [4.0]), (1, 29, [5.0]), (1, 39, [6.0]), (1, 50, [7.0]), (2, 6, [8.0]), (4, 1, [9.0])],
        "run_id bigint, frame_index bigint, anchor array<double>",
    ).withColumn("anchor_hist", F.col("anchor"))
    stream, table = folder(spark, "run_id bigint, frame_index bigint", *frames)
    out, checkpoint = new(), new()
    call = lambda: K.drained(anchor_stream(stream, anchors), out, checkpoint)
    got = sorted((r.run_id, r.frame_index, r.anchor) for r in call().collect())
    want = sorted((r.run_id, r.frame_index, r.anchor) for r in anchor_feed(table, anchors).collect())
    assert got == want and sum(a is not None for *_, a in got) == 5
    assert call().count() == len(want)  # a restart from the checkpoint serves nothing twice


def test_lowpass_on_a_stream_equals_the_table_over_restarts(spark):
    from stridegrid.operators.recurrences import one_euro
    from stridegrid.plans.blocks import RUNS
    from stridegrid.streaming.filters import one_euro_stream

    wave = lambda r, f: None if (f * r) % 7 == 3 else float((f * 37 + r * 11) % 50) / 10
    rows = [(r, f, wave(r, f), None if f < 40 else float(f % 9)) for r in (1, 2, 5) for f in range(90)]
    schema = "run_id bigint, frame_index bigint, v double, w double"
    table = spark.createDataFrame(rows, schema)
    columns = {"a": ("v", 1.0, 0.3), "b": ("w", 0.5, 0.15)}
    want = sorted(map(tuple, one_euro(table, 30.0, columns, RUNS).select("run_id", "frame_index", "a", "b").collect()))
    src, out, checkpoint = new("src"), new(), new()
    for lo, hi in ((0, 11), (11, 60), (60, 90)):
        table.where(F.col("frame_index").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(src)
        got = K.drained(one_euro_stream(spark.readStream.schema(schema).parquet(src), 30.0, columns), out, checkpoint)
    got = sorted(map(tuple, got.collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[2:] == pytest.approx(b[2:], abs=1e-9)
    table.where("run_id = 1 AND frame_index = 4").write.mode("append").parquet(src)  # late
    again = K.drained(one_euro_stream(spark.readStream.schema(schema).parquet(src), 30.0, columns), out, checkpoint)
    late = again.where("run_id = 1 AND frame_index = 4 AND a IS NULL AND b IS NULL")
    assert again.count() == len(want) + 1 and late.count() == 1


def test_hands_on_a_stream_equal_the_table_over_restarts(spark):
    from stridegrid.operators.hands import hand_temporal
    from stridegrid.streaming.filters import hand_stream

    rows = []
    for r in (1, 2):
        for f in range(80):
            x = 300.0 + f + (700 if f == 33 else 0)
            away = (f * r) % 13 in (4, 5) or 50 <= f < 50 + 14 * r
            seen = None if away else [x, 200.0, x + 80, 300.0]
            shape = None if f % 5 == 2 or away else [float((f * k) % 7) for k in range(48 if f < 40 else 51)]
            rows.append((r, f, [x, 195.0, x + 80, 300.0] if f % 6 == 0 else None, seen, shape, "t", "raw_output" if f % 3 else "tracked"))
    schema = (
        "run_id bigint, frame_index bigint, prior array<double>, measured array<double>, "
        "vertices array<double>, topology string, source string"
    )
    table = spark.createDataFrame(rows, schema)
    want = hand_temporal(table, 1280, 720).orderBy("run_id", "frame_index").collect()
    src, out, checkpoint = new("src"), new(), new()
    for lo, hi in ((0, 5), (5, 31), (31, 55), (55, 80)):  # borders within absences
        table.where(F.col("frame_index").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(src)
        got = K.drained(hand_stream(spark.readStream.schema(schema).parquet(src), 1280, 720), out, checkpoint)
    assert got.orderBy("run_id", "frame_index").collect() == want
    assert {r.status for r in want} >= {"tracked", "reentry_blend", "occluded_hold", "drift_reject_hold", "lost_empty", "bbox_only"}
    assert {r.shape_origin for r in want} == {"measured", "ema", "hold", "empty", "reentry_interp"}
