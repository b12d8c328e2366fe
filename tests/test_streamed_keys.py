"""Steps that hold many keys run in whole tasks, not key by key, and do not depend on where Arrow batches end."""

import pytest
from pyspark.sql import functions as F

from stridegrid.operators import joins as J
from stridegrid.operators import recurrences as R
from stridegrid.operators.hands import hand_temporal
from stridegrid.operators.locks import identity_lock
from stridegrid.operators.tracking import segmented_tracks, track_identities
from stridegrid.plans import blocks as B
from stridegrid.plans.blocks import Line
from stridegrid.sources import adapters as A


@pytest.fixture
def batches(spark):
    def of(rows):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)

    yield of
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def told(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def series(spark, runs=40, rows=9):
    n = F.col("id")
    return spark.range(runs * rows).select(
        (n / rows).cast("long").alias("run_id"), (n % rows).alias("frame_index"), F.when(n % 4 != 1, (n * 37 % 101).cast("double")).alias("v")
    )


def dets(spark, videos=12, frames=9):
    n = F.col("id")
    x = (n % 3 * 200 + (n / 3).cast("long") % frames * 2).cast("double")
    return spark.range(videos * frames * 3).select(
        F.when(n >= frames * 3, (n / (3 * frames)).cast("long")).alias("video_id"), ((n / 3).cast("long") % frames).alias("frame"),
        (n % 3).alias("det_id"), x.alias("x1"), F.lit(10.0).alias("y1"), (x + 60).alias("x2"), F.lit(190.0).alias("y2"),
    )


def test_recurrences_take_all_blocks_of_a_task(spark, batches, capsys):
    for op in (
        lambda: R.ema(series(spark), "v", 0.35, "out", Line(block=4)),
        lambda: R.one_euro(series(spark), 30.0, {"out": ("v", 1.0, 0.3)}, Line(block=4)),
    ):
        batches(10_000)
        whole = told(op())
        batches(7)
        assert told(op()) == whole
        assert "FlatMapGroups" not in plan(op(), capsys)


def test_trackers_take_all_keys_of_a_task(spark, batches, capsys):
    frames = dets(spark).withColumn("scene_change", F.col("frame") % 5 == 4)
    for op in (lambda: track_identities(dets(spark)), lambda: segmented_tracks(frames.where("video_id IS NOT NULL"), 2)):
        batches(10_000)
        whole = told(op())
        assert whole
        batches(7)
        assert told(op()) == whole
        assert "FlatMapGroups" not in plan(op(), capsys)
    ids = track_identities(dets(spark)).groupBy("video_id").agg(F.max("track_id").alias("most")).collect()
    assert len(ids) == 12 and {r["most"] for r in ids} == {2}  # every video starts anew, the one without id too


def test_lock_and_hand_take_all_keys_of_a_task(spark, batches, capsys):
    box = F.array("x1", "y1", "x2", "y2")
    hist = F.array(F.col("x1") + 1, F.lit(3.0), F.lit(5.0))
    one = dets(spark).where("det_id = 0").withColumnsRenamed({"video_id": "run_id", "frame": "frame_index"})
    lock = one.select("run_id", "frame_index", box.alias("proposed"), hist.alias("proposed_hist"))
    hand = one.select(
        "run_id", "frame_index", box.alias("prior"), F.when(F.col("frame_index") % 3 != 1, box).alias("measured"),
        F.when(F.col("frame_index") % 4 != 2, hist).alias("vertices"), F.lit("t").alias("topology"), F.lit("raw_output").alias("source"),
    )
    for op in (lambda: identity_lock(lock, 1280, 720), lambda: hand_temporal(hand, 1280.0, 720.0)):
        batches(10_000)
        whole = told(op())
        batches(7)
        assert told(op()) == whole
        assert len(whole) == 12 * 9
        assert "FlatMapGroups" not in plan(op(), capsys)


def test_wanted_tracks_meet_the_detections_where_they_are(spark, capsys):
    subjects = spark.createDataFrame([(0, [0, 2]), (1, [1])], "subject_id int, track_ids array<long>")
    rows = dets(spark).withColumns({"track_id": F.col("det_id"), "score": F.lit(0.5)})
    text = plan(J.select_subject_tracks(rows, subjects, 1280.0, 720.0), capsys)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_boxes_are_numbered_where_a_picture_meets(spark, tmp_path, monkeypatch, capsys):
    n = F.col("id")
    spark.range(4_000).select(
        (n % 900).alias("l_orderkey"), (n % 50).alias("l_partkey"), F.when(n % 31 != 0, n % 7).alias("l_suppkey"), (n / 900).cast("int").alias("l_linenumber"),
        (n % 11).cast("double").alias("l_quantity"), n.cast("double").alias("l_extendedprice"), F.lit(0.1).alias("l_discount"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    text = plan(A.boxes(spark, str(tmp_path)), capsys)
    assert "Join" not in text and text.count("Exchange") == 1
    whole = told(A.boxes(spark, str(tmp_path)))
    assert len(whole) == sum(i % 31 != 0 for i in range(4_000))
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    many = A.boxes(spark, str(tmp_path))
    assert told(many) == whole and "REPARTITION_BY_NUM" in plan(many, capsys)
