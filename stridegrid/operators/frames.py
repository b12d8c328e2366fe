"""Frame tables: sampling, clocks, status, joins of frames with records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegrid.functions.numbers import round_half_up
from stridegrid.functions.pose import subject_present
from stridegrid.plans.blocks import RUNS, Line, running


def frame_sampler(
    df: DataFrame, start: int = 0, stride: int = 1, most: int | None = None, line: Line = RUNS
) -> DataFrame:
    """Frames from ``start`` at every ``stride``, at most ``most`` per run."""
    pos = F.col(line.pos)
    picked = df.where((pos >= start) & (pos % stride == 0))
    if most is None:
        return picked
    picked = running(picked, line, _nth=("sum", F.lit(1)))
    return picked.where(F.col("_nth") <= most).drop("_nth")


def frame_time(index: Column, video_frame: Column, fps: Column, timebase: str) -> Column:
    rate = F.greatest(F.lit(1.0), fps)
    return (F.coalesce(video_frame, index) if timebase == "source" else index) / rate


def frame_at_time(seconds: Column, fps: Column, last: Column) -> Column:
    at = round_half_up(seconds * F.greatest(F.lit(1.0), fps))
    return F.least(F.greatest(at, F.lit(0)), last).cast("long")


def frame_record_join(frames: DataFrame, records: DataFrame, line: Line = RUNS) -> DataFrame:
    """Every frame with the record at the same position, if there is one."""
    return frames.join(records, [*line.keys, line.pos], "left")


def normalize_frames(joined: DataFrame) -> DataFrame:
    """Presence, status and score of frames joined with their records.

    Absent frames lose mesh, joints and box; the score is the gallery
    similarity, or the stability score where there is none.
    """
    have = set(joined.columns)

    def first_of(*names: str) -> Column:
        found = [F.col(n) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None)

    status = first_of("inference_status", "record_inference_status")
    present = subject_present(
        first_of("subject_present").cast("boolean"),
        first_of("identity_is_lost").cast("boolean"),
        status.cast("string"),
    )
    out = joined.withColumn("present", present).withColumn(
        "tracking_score",
        F.when(
            F.col("present"),
            first_of("identity_gallery_similarity", "identity_stability_score").cast("double"),
        ),
    )
    for c in ("mesh_file", "joints_cam", "bbox"):
        if c in have:
            out = out.withColumn(c, F.when(F.col("present"), F.col(c)))
    return out


def absent_records(frames: DataFrame, reason: str) -> DataFrame:
    """Records of frames without a subject: no mesh, no joints, and what the tracker still knows.

    The last box is kept. Identity columns are read where ``frames`` has them;
    without them, or where null, the status is ``reason``, the identity counts
    as lost, no frame as lost so far, and nothing was scanned.
    """
    have = set(frames.columns)

    def told(name: str, kind: str, default: object = None) -> Column:
        return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in have else F.lit(default).cast(kind)

    return frames.select(
        "run_id",
        "frame_index",
        told("video_frame", "long").alias("video_frame") if "video_frame" in have else F.col("frame_index").alias("video_frame"),
        F.lit(None).cast("string").alias("mesh_file"),
        F.lit(None).cast("array<array<double>>").alias("joints_cam"),
        told("bbox", "array<double>").alias("bbox"),
        F.lit(False).alias("subject_present"),
        F.lit(reason).alias("inference_status"),
        F.lit(reason).alias("tracking_status"),
        told("identity_status", "string", reason).alias("identity_status"),
        told("identity_is_lost", "boolean", True).alias("identity_is_lost"),
        told("identity_lost_frames", "int", 0).alias("identity_lost_frames"),
        told("identity_appearance_similarity", "double").alias("identity_appearance_similarity"),
        told("identity_stability_score", "double").alias("identity_stability_score"),
        told("identity_reacquire_scanned", "boolean", False).alias("identity_reacquire_scanned"),
        told("identity_reacquire_candidates", "int", 0).alias("identity_reacquire_candidates"),
    )


def view_window(df: DataFrame, start: Column, span: Column, last: Column, line: Line = RUNS):
    """Slice of ``span`` frames from ``start``, kept inside the run."""
    lo = F.greatest(F.lit(0), F.least(start, last - span + 1))
    return df.where((F.col(line.pos) >= lo) & (F.col(line.pos) < lo + span))
