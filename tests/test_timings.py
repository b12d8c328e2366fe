"""Timings gathered while an action runs."""

from stridegrid.operators import aggregates as G


def test_observed_totals_equal_the_summary_and_rows_stay(spark, tmp_path):
    rows = [(1, 2.0, None), (1, 4.5, 1.0), (2, None, 3.0)]
    df = spark.createDataFrame(rows, "run_id bigint, detect double, infer double")
    same, seen = G.observed_timings(df, ["detect", "infer"])
    same.write.parquet(str(tmp_path / "out"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, df.collect()))
    got = G.timing_row(spark, seen, ["detect", "infer"]).first()
    want = G.timing_summary(df, ["detect", "infer"], []).first()
    assert got.asDict() == want.asDict() and got.frames == 3


def test_totals_of_no_rows_are_null(spark, tmp_path):
    none, seen = G.observed_timings(spark.createDataFrame([], "detect double"), ["detect"])
    none.write.parquet(str(tmp_path / "out"))
    got = G.timing_row(spark, seen, ["detect"]).first()
    assert (got.frames, got.detect_total, got.detect_per_frame) == (0, None, None)
