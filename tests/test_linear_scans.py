"""Scans and folds whose time goes by the length of a timeline, not by its square."""

import random

from stridegrid.operators import events as E
from stridegrid.plans.blocks import Line, running
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString().lower()


def test_backward_scans_grow_row_by_row(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, rng.randint(0, 9)])) for k in (1, 2) for i in range(70)]
    df = spark.createDataFrame(rows, "run_id bigint, frame_index bigint, v bigint")
    out = running(df, Line(block=16), at=("next", F.col("v")), past=("after", F.col("v")))
    assert "unboundedfollowing" not in _plan(out)
    got = {(r.run_id, r.frame_index): (r.at, r.past) for r in out.collect()}
    for k in (1, 2):
        v = [x[2] for x in rows if x[0] == k]
        for i in range(70):
            first = lambda at: next((x for x in v[at:] if x is not None), None)
            assert got[k, i] == (first(i), first(i + 1))


def _kept(rows, gap, higher):
    kept = []
    for p, h in sorted(rows):
        if not kept or p - kept[-1][0] >= gap:
            kept.append((p, h))
        elif higher and h > kept[-1][1]:
            kept[-1] = (p, h)
    return kept


def test_one_long_burst_streams_through_a_task(spark):
    rng = random.Random(5)
    at = sorted(rng.sample(range(30_000), 15_000))
    rows = [(k, p, float(rng.randint(0, 5))) for k in (1, 2) for p in at[k::1]]
    df = spark.createDataFrame(rows, "run_id bigint, frame_index bigint, lift double")
    for gap, higher in ((4, True), (4, False), (400, True)):
        out = E.min_gap_peaks(df, gap) if higher else E.spaced_events(df, gap, extra=("lift",))
        assert "collect_list" not in _plan(out)
        got = sorted((r.run_id, r.frame_index, r.lift) for r in out.collect())
        want = [(k, p, h) for k in (1, 2) for p, h in _kept([x[1:] for x in rows if x[0] == k], gap, higher)]
        assert got == sorted(want)


def test_missing_places_and_heights(spark):
    rows = [(1, 0, None), (1, 2, 5.0), (1, 9, 1.0), (1, 10, float("nan")), (1, 11, 7.0), (None, 3, 1.0), (None, 4, 2.0)]
    df = spark.createDataFrame(rows, "run_id bigint, frame_index bigint, lift double")
    got = {(r.run_id, r.frame_index) for r in E.min_gap_peaks(df, 5).collect()}
    assert got == {(1, 0), (1, 10), (None, 4)}
    assert E.min_gap_peaks(df.where("false"), 5).count() == 0
