"""Gait scenarios with known truth."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridegrid.plans import analysis as AN
from stridegrid.plans.blocks import Line

FPS = 60.0
SCHEMA = (
    "run_id int, frame_index long, subject_present boolean, joints array<array<double>>, "
    "left boolean, right boolean"
)


def cam(p):
    return [float(p[1]), float(-p[2]), float(-p[0])]


def body(hip, knee_l, knee_r, ankle_l, ankle_r, toe_dir, foot_pitch=0.0):
    joints = [[0.0, 0.0, 0.0] for _ in range(21)]
    side = np.array([0.1, 0, 0])
    joints[5], joints[6] = cam(hip - side + [0, 0, 0.5]), cam(hip + side + [0, 0, 0.5])
    joints[9], joints[10] = cam(hip - side), cam(hip + side)
    for (k, a, t1, t2, h), knee, ankle, s in (
        ((11, 13, 15, 16, 17), knee_l, ankle_l, -side),
        ((12, 14, 18, 19, 20), knee_r, ankle_r, side),
    ):
        joints[k], joints[a] = cam(knee + s), cam(ankle + s)
        lift = math.tan(math.radians(foot_pitch)) * 0.2
        joints[t1] = joints[t2] = cam(ankle + s + toe_dir * 0.15 + [0, 0, lift - 0.05])
        joints[h] = cam(ankle + s - toe_dir * 0.05 + [0, 0, -0.05])
    return joints


def walker(planted=False, seconds=12):
    rng = np.random.default_rng(7)
    out = []
    ahead = np.array([0.0, 1.0, 0.0])
    for i in range(int(seconds * FPS)):
        t = i / FPS
        hip = np.array([0, 1.25 * t, 0.95])
        phase = 2 * math.pi * t / 1.2
        legs = {}
        for s, shift in (("l", 0.0), ("r", math.pi)):
            w = math.sin(phase + shift)
            swing = 0.30 * math.sin(phase + shift - math.pi / 2)
            ankle = np.array([0, 1.25 * t + swing, 0.08 + max(0.0, 0.10 * w)])
            knee = (hip + ankle) / 2 + ahead * 0.05
            legs[s] = (knee, ankle, w <= 0)
        j = body(hip, legs["l"][0], legs["r"][0], legs["l"][1], legs["r"][1], ahead)
        j = (np.asarray(j) + rng.normal(scale=0.004, size=(21, 3))).tolist()
        out.append((1, i, True, j, planted or legs["l"][2], planted or legs["r"][2]))
    return out


def layer(spark, rows, fps=FPS, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return AN.gait_layer(df, df.select("run_id", "frame_index", "left", "right"), fps, **kw)


@pytest.fixture(scope="module")
def walk(spark):
    return layer(spark, walker())


def test_walker_parameters(walk):
    p = walk["parameters"].first()
    assert p.walking_detected
    assert abs(p.cadence_steps_per_min - 100) < 5
    assert abs(p.stride_time_mean - 1.2) < 0.06
    assert abs(p.stride_length_mean - 1.5) < 0.15
    assert abs(p.walking_speed_mean - 1.25) < 0.15
    assert 30 < p.stance_pct_mean < 70
    assert abs(p.stance_pct_mean + p.swing_pct_mean - 100) < 1e-3


def test_walker_events_and_cycles(walk):
    hs = walk["events"].where("type = 'heel_strike'").groupBy("side").count().collect()
    assert {r.side for r in hs} == {"left", "right"} and all(9 <= r["count"] <= 11 for r in hs)
    cycles = walk["cycles"].where("signal_id = 'gait.knee.left.flexion_deg'").collect()
    assert len(cycles) == 101 and min(r.n_cycles for r in cycles) >= 7
    assert np.mean([r.sd for r in cycles]) < 6


def test_standing_is_not_walking(spark):
    out = layer(spark, walker(planted=True, seconds=4))
    assert not out["parameters"].first().walking_detected
    assert out["cycles"].count() == 0


def stance(shank=0.0, foot=0.0, n=240):
    ahead = np.array([0.0, 1.0, 0.0])
    hip = np.array([0, 0, 0.95])
    knee = hip - [0, 0, 0.45]
    ankle = knee + 0.42 * np.array([0, -math.sin(math.radians(shank)), -math.cos(math.radians(shank))])
    j = body(hip, knee, knee, ankle, ankle, ahead, foot)
    return [(1, i, True, j, True, True) for i in range(n)]


def test_biased_stance_is_calibrated(spark):
    out = layer(spark, stance(19.4, 15.5))
    n = out["neutral"].first()
    assert n.applied and abs(n.offset_ankle_left - 34.9) < 1.5
    med = out["angles"].toPandas()[["hip_left", "knee_left", "ankle_left"]].astype(float).median()
    assert (med.abs() < 0.5).all()


def test_crouch_is_refused_and_straight_leg_reads_zero(spark):
    assert not layer(spark, stance(60, 40))["neutral"].first().applied
    raw = layer(spark, stance(n=40))
    assert not raw["neutral"].first().applied
    med = raw["angles"].toPandas()[["hip_left", "knee_left", "ankle_left"]].astype(float).median()
    assert (med.abs() < 5).all()


def test_analysis_signals_of_two_runs_are_independent(spark):
    rows = walker(seconds=2)
    one = spark.createDataFrame(rows, SCHEMA).withColumn("camera_comp", F.array(*[F.lit(0.0)] * 3))
    two = one.unionByName(one.withColumn("run_id", F.lit(2)).where("frame_index < 50"))
    cols = ["frame_index", *AN.SIGNALS]
    a = AN.analysis_signals(one, FPS).orderBy("frame_index").select(*cols).toPandas()
    b = AN.analysis_signals(two, FPS, Line(block=32)).where("run_id = 1").orderBy("frame_index").select(*cols).toPandas()
    assert len(a) == len(rows)
    pd.testing.assert_frame_equal(a.astype(float), b.astype(float), atol=1e-9)
