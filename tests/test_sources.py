"""Readers over real files, CSV order, manifests."""

import json
import os

from pyspark.sql import functions as F

from stridegrid.sources import readers as RD
from stridegrid.sources import writers as WR


def test_run_folder_is_read(spark, tmp_path):
    for run, fps in (("walk_a", 25), ("walk_b", None)):
        os.makedirs(tmp_path / run)
        doc = {
            "video_input": "v.mp4", "fps_output": fps,
            "records": [
                {"video_frame": 4, "joints_cam_xyz": [[1, 2, 3]], "mesh_path": "m/f.ply", "subject_present": True},
                "junk",
                {"video_frame": 5, "joints_cam_xyz": [[1, 2]], "identity_is_lost": True},
            ],
        }
        (tmp_path / run / "run_metadata.json").write_text(json.dumps(doc, indent=1))
    runs, frames = RD.read_runs(spark, str(tmp_path / "*" / "*.json"))
    assert {(r.run_id, r.fps) for r in runs.collect()} == {("walk_a", 25.0), ("walk_b", 30.0)}
    rows = frames.where("run_id = 'walk_a'").orderBy("frame_index").collect()
    assert [(r.frame_index, r.video_frame, r.mesh_file) for r in rows] == [(0, 4, "f.ply"), (1, 5, None)]
    assert rows[0].joints == [[1.0, 2.0, 3.0]] and rows[1].joints is None


def test_malformed_lines_are_skipped(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(
        '{"f":0,"t":0.0,"dets":[{"id":1,"b":[0.1,0.1,0.2,0.2],"s":0.9}]}\n{"f":1,"dets":[\n{"f":2,"t":0.1,"dets":[]}\n'
        '{"f":3,"t":0.2,"dets":[{"id":2,"b":[0.1,0.1,0.2,0.2]}]}\n'
    )
    out = RD.read_detection_stream(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(r.frame, r.track_id, r.score) for r in out] == [(0, 1, 0.9), (3, 2, 1.0)]


def test_csv_has_units_first_and_frames_in_order(spark, tmp_path):
    wide = spark.createDataFrame(
        [("r", i, i * 2, i / 3, [[float(i), 0.5, 1.0]]) for i in range(30)],
        "run_id string, frame_index long, video_frame long, speed double, joints array<array<double>>",
    )
    rows = WR.kinematics_csv_rows(wide.repartition(4), ["speed"], {"speed": "m/s"}, 30.0, joints=1)
    WR.write_kinematics_csv(rows, str(tmp_path / "csv"))
    part = next((tmp_path / "csv" / "run_id=r").glob("*.csv")).read_text().splitlines()
    assert part[0].split(",") == ["frame_index", "video_frame", "timestamp_ms", "speed", "joint00_x", "joint00_y", "joint00_z"]
    assert part[1].split(",")[2:4] == ["ms", "m/s"]
    assert [p.split(",")[0] for p in part[2:]] == [str(i) for i in range(30)]
    assert part[3].split(",")[3] == "0.333333" and part[5].split(",")[3] == "1"


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "run_id string, analysis_id string, v int")
    new = spark.createDataFrame([("r", "b", 9), ("r", "c", 3)], "run_id string, analysis_id string, v int")
    once = WR.upsert_analysis(old, new)
    want = {("r", "a", 1), ("r", "b", 9), ("r", "c", 3)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in WR.upsert_analysis(once, new).collect()} == want


def test_manifests_are_recorded_in_place(spark, tmp_path):
    import json
    import os

    from pyspark.sql import functions as F

    from stridegrid.sources import writers as WR

    runs = spark.createDataFrame([(i, f"v{i}.mp4", 30.0, 1280) for i in range(40)], "run_id long, source_video string, fps double, video_width int")
    path = str(tmp_path / "m")
    WR.write_manifests(WR.run_manifests(runs, F.lit("t0")), path, parts=8)
    schema = "run_id long, analysis_id string, preset string, created_at string, parameters string, qa_summary string"
    first = spark.createDataFrame([(1, "b", "p", "t2", "{}", "q2"), (1, "a/x", "p", "t1", "{}", "q1"), (99, "a", "p", "t1", "{}", "q")], schema)
    WR.upsert_manifests(path, first, parts=8)
    parts = [d for d in os.listdir(path) if d.startswith("part=")]
    files = lambda: {f"{d}/{f}" for d in parts for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")}
    before = files()
    WR.upsert_manifests(path, spark.createDataFrame([(1, "a/x", "p", "t3", "{}", None)], schema), parts=8)
    assert len(before - files()) == 1  # one partition was written again
    rows = {r.run_id: r for r in spark.read.parquet(path).collect()}
    assert len(rows) == 40 and 99 not in rows
    one, two = rows[1], rows[2]
    assert [a.analysis_id for a in one.analyses] == ["b", "a/x"] and one.latest_analysis_id == "a/x"
    assert one.quality_summary is None and one.updated_at == "t3" and one.created_at == "t0"
    assert one.analyses[1].artifacts.kinematics == "analysis/a_x/kinematics.parquet"
    assert two.analyses == [] and two.latest_analysis_id is None and two.updated_at == "t0"
    doc = json.loads(WR.manifest_documents(spark.read.parquet(path).drop("part").where("run_id = 2")).first().manifest)
    assert doc["video_width"] == 1280 and doc["subject"] is None and doc["model_versions"]["mhr_path"] is None
    assert doc["artifacts"]["preview_video"] is None and doc["analysis_profiles"] == {"default": "kinematics_v1"}


def test_absent_records_keep_what_the_tracker_knows(spark):
    from stridegrid.operators.frames import absent_records

    bare = absent_records(spark.createDataFrame([(1, 4)], "run_id long, frame_index long"), "gone").first()
    assert bare.identity_status == "gone" and bare.identity_is_lost and bare.identity_lost_frames == 0
    assert bare.bbox is None and bare.identity_reacquire_scanned is False and bare.video_frame == 4
    held = spark.createDataFrame(
        [(1, 4, [1.0, 2.0, 3.0, 4.0], "reacquiring", False, 7, 0.5, True, 3)],
        "run_id long, frame_index long, bbox array<double>, identity_status string, identity_is_lost boolean, "
        "identity_lost_frames int, identity_appearance_similarity double, identity_reacquire_scanned boolean, identity_reacquire_candidates int",
    )
    full = absent_records(held, "gone").first()
    assert (full.identity_status, full.identity_is_lost, full.identity_lost_frames) == ("reacquiring", False, 7)
    assert full.bbox == [1.0, 2.0, 3.0, 4.0] and full.identity_reacquire_candidates == 3 and full.inference_status == "gone"


def test_a_folder_of_detections_or_kinematics_is_one_file(spark, tmp_path):
    dets = spark.range(400).selectExpr("id % 5 AS video_id", "id AS frame", "0L AS det_id", "1.0D AS x1").repartition(4)
    WR.raw_detection_dump(dets, str(tmp_path / "raw"))
    assert len(list((tmp_path / "raw").glob("video_id=*/*.parquet"))) == 5
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 400
    frames = spark.range(400).selectExpr("id % 5 AS run_id", "id AS frame_index", "id AS video_frame", "'m' AS mesh_file")
    signals = frames.selectExpr("run_id", "frame_index", "'speed' AS signal_id", "1.0D AS value")
    WR.write_kinematics_parquet(signals, frames.repartition(4), ["speed"], str(tmp_path / "wide"))
    assert len(list((tmp_path / "wide").glob("run_id=*/*.parquet"))) == 5
    assert spark.read.parquet(str(tmp_path / "wide")).where("speed = 1").count() == 400
