"""Streams with typed state in a session left at Spark's default state store."""

import tempfile

import pytest
from pyspark.sql import functions as F

from stridegrid.operators.recurrences import ONE_EURO
from stridegrid.streaming import sinks as K
from stridegrid.streaming.anchors import anchor_stream
from stridegrid.streaming.filters import one_euro_stream
from stridegrid.streaming.segments import end_rows, segment_stream

STORE = "spark.sql.streaming.stateStore.providerClass"
DEFAULT = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


@pytest.fixture
def plain(spark):
    """A session as a driver brings it: its state store is Spark's default."""
    held = spark.conf.get(STORE)
    spark.conf.set(STORE, DEFAULT)
    yield spark
    spark.conf.set(STORE, held)


def _rows(spark, df, build):
    path = tempfile.mkdtemp(prefix="stridegrid-src-")
    df.write.mode("overwrite").parquet(path)
    stream = build(spark.readStream.schema(df.schema).parquet(path))
    new = tempfile.mkdtemp(prefix="stridegrid-t-")
    return K.drained(stream, f"{new}/out", f"{new}/state")


def test_anchor_stream_under_the_default_store(plain):
    frames = plain.createDataFrame([(1, 0), (1, 2), (1, 4)], "run_id bigint, frame_index bigint")
    anchors = plain.createDataFrame([(1, 1, "a")], "run_id bigint, frame_index bigint, name string")
    out = _rows(plain, frames, lambda s: anchor_stream(s, anchors))
    assert sorted(map(tuple, out.collect())) == [(1, 0, None), (1, 2, "a"), (1, 4, None)]


def test_one_euro_stream_under_the_default_store(plain):
    rows = plain.createDataFrame([(1, 0, 2.0), (1, 1, 2.0)], "run_id bigint, frame_index bigint, v double")
    out = _rows(plain, rows, lambda s: one_euro_stream(s, 30.0, {"smooth": ("v", *ONE_EURO["x"])}))
    assert sorted(map(tuple, out.collect())) == [(1, 0, 2.0), (1, 1, 2.0)]


def test_segment_stream_under_the_default_store(plain):
    box = "video_id bigint, frame bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, scene_change boolean"
    dets = plain.createDataFrame([(7, f, 0, 10.0, 10.0, 50.0, 90.0, False) for f in range(4)], box)
    out = _rows(plain, dets.unionByName(end_rows(dets)), lambda s: segment_stream(s, 1))
    assert out.where(F.col("track_id") == 0).count() == 4
