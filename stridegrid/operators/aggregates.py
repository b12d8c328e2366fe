"""Aggregates over runs, tracks and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stridegrid.functions.boxes import Box, candidate_score, pinhole_project, rect_pad
from stridegrid.functions.numbers import camera_motion_severity, clip, finite_or_null, norm2
from stridegrid.plans.blocks import RUNS, Line, dense_position, neighbourhood, running
from stridegrid.plans.quantiles import exact_quantiles


def sample_sd(c: Column) -> Column:
    """Sample standard deviation, 0 for a single value, null for none."""
    return F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))


def mean_sd_n(df: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    v = finite_or_null(F.col(value))
    return df.groupBy(*keys).agg(
        F.round(F.avg(v), digits).alias("mean"),
        F.round(sample_sd(v), digits).alias("sd"),
        F.count(v).alias("n"),
    )


def qa_summary(frames: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Joint visibility, interpretability and tracking score per run."""
    size = F.coalesce(F.size("joints"), F.lit(0))
    out = frames.groupBy("run_id").agg(
        F.avg((size > 0).cast("double")).alias("joint_visibility_ratio"),
        F.avg((size > 20).cast("double")).alias("critical_joint_visibility_ratio"),
        F.avg("stability").alias("tracking_score"),
    )
    status = (
        F.when(F.col("critical_joint_visibility_ratio") < 0.25, "non_interpretable")
        .when(F.col("joint_visibility_ratio") < 0.60, "needs_review")
        .otherwise("interpretable")
    )
    out = out.withColumn("status", status).withColumns(
        {
            "needs_review": F.col("status") != "interpretable",
            "reason": F.when(F.col("status") == "non_interpretable", "critical_joints_missing").when(
                F.col("status") == "needs_review", "low_joint_visibility"
            ),
        }
    )
    if runs is None:
        return out
    severity = runs.select(
        "run_id", camera_motion_severity(F.col("camera_shift_px")).alias("camera_motion_severity")
    )
    return out.join(severity, "run_id", "left")


def xy_stability(df: DataFrame, x: str, y: str, out: str = "score", line: Line = RUNS) -> DataFrame:
    """Extent of the path plus its net displacement, per run."""
    pos = F.col(line.pos)
    at = F.struct(pos.alias("p"), F.col(x).alias("x"), F.col(y).alias("y"))
    agg = df.groupBy(*line.keys).agg(
        F.min(x).alias("_a"), F.max(x).alias("_b"), F.min(y).alias("_c"), F.max(y).alias("_d"),
        F.min(at).alias("_s"), F.max(at).alias("_e"), F.count(F.lit(1)).alias("_n"),
    )
    score = norm2(F.col("_b") - F.col("_a"), F.col("_d") - F.col("_c")) + norm2(
        F.col("_e.x") - F.col("_s.x"), F.col("_e.y") - F.col("_s.y")
    )
    return agg.select(*line.keys, F.when(F.col("_n") < 2, 0.0).otherwise(score).alias(out))


def choose_trajectory(
    df: DataFrame, first: tuple[str, str], second: tuple[str, str], line: Line = RUNS
) -> DataFrame:
    """Whole-run choice of the steadier of two paths; a tie keeps ``second``."""
    a = xy_stability(df, *first, "_first", line)
    b = xy_stability(df, *second, "_second", line)
    pick = F.col("_first") < F.col("_second")
    return (
        df.join(a.join(b, list(line.keys)), list(line.keys))
        .withColumns(
            {
                "stable_x": F.when(pick, F.col(first[0])).otherwise(F.col(second[0])),
                "stable_y": F.when(pick, F.col(first[1])).otherwise(F.col(second[1])),
            }
        )
        .drop("_first", "_second")
    )


def double_support(strides: DataFrame, contact: DataFrame, line: Line = RUNS) -> DataFrame:
    """Share of each stride with both feet down, from a running count."""
    keys, pos = list(line.keys), line.pos
    both = (F.col("left") & F.col("right")).cast("int")
    counted = running(contact.select(*keys, pos, both.alias("_both")), line, _c=("sum_before", F.col("_both")))
    at = counted.select(*keys, F.col(pos).alias("_f"), F.coalesce("_c", F.lit(0)).alias("_c"))
    a = at.select(*keys, F.col("_f").alias("start_frame"), F.col("_c").alias("_a"))
    b = at.select(*keys, F.col("_f").alias("end_frame"), F.col("_c").alias("_b"))
    return (
        strides.join(a, [*keys, "start_frame"])
        .join(b, [*keys, "end_frame"])
        .withColumn(
            "double_support_pct",
            100.0 * (F.col("_b") - F.col("_a")) / (F.col("end_frame") - F.col("start_frame")),
        )
        .drop("_a", "_b")
    )


def cycle_curve(cycles: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and deviation per percent point, and the number of cycles."""
    return cycles.groupBy(*keys, "pct").agg(
        F.round(F.avg("value"), 3).alias("mean"),
        F.round(sample_sd(F.col("value")), 3).alias("sd"),
        F.count("value").alias("n_cycles"),
    )


def tracklet_color(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Component-wise median colour."""
    a = exact_quantiles(samples, keys, "tab_a", {"color_a": 0.5})
    return a.join(exact_quantiles(samples, keys, "tab_b", {"color_b": 0.5}), keys)


def track_summary(dets: DataFrame, keys: list[str], min_surface: int = 2, on: str = "frame") -> DataFrame:
    """First, last and representative frame of each confirmed track."""
    area = Box.of().raw_area
    return (
        dets.groupBy(*keys)
        .agg(
            F.min(on).alias("first_frame"),
            F.max(on).alias("last_frame"),
            F.count(F.lit(1)).alias("frame_count"),
            F.max(F.struct(area.alias("a"), (-F.col(on)).alias("f"))).alias("_rep"),
        )
        .where(F.col("frame_count") >= max(min_surface, 2))
        .withColumn("rep_frame", -F.col("_rep.f"))
        .drop("_rep")
    )


def merge_subjects(tracks: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks grouped into subjects; ``merges`` maps track_id to a group.

    A track without a mapping is its own subject, which also undoes a merge.
    The subject id is the smallest track id; labels follow the size.
    """
    mapped = tracks.join(merges, [*keys, "track_id"], "left").withColumn(
        "_g", F.coalesce("group_id", F.col("track_id"))
    )
    longest = F.struct(F.col("frame_count").alias("c"), (-F.col("track_id")).alias("t"), "rep_frame")
    grouped = mapped.groupBy(*keys, "_g").agg(
        F.min("track_id").alias("subject_id"),
        F.sum("frame_count").alias("frame_count"),
        F.min("first_frame").alias("first_frame"),
        F.max("last_frame").alias("last_frame"),
        F.max(longest)["rep_frame"].alias("rep_frame"),
    )
    labelled = dense_position(
        grouped.withColumn("_neg", -F.col("frame_count")), keys, ["_neg", "subject_id"],
        F.floor(F.col("_neg") / 16), "label",
    )
    return labelled.withColumn("label", F.col("label") + 1).drop("_g", "_neg")


def bbox_from_points(points: DataFrame, keys: list[str], focal: float, width: float, height: float) -> DataFrame:
    """Trimmed rectangle of the projected points that fall inside the picture."""
    u, v, ok = pinhole_project(F.col("x"), F.col("y"), F.col("z"), F.lit(focal), width, height)
    seen = points.select(*keys, u.alias("u"), v.alias("v"), ok.alias("_ok")).where(
        F.col("_ok") & F.col("u").between(0.0, width - 1) & F.col("v").between(0.0, height - 1)
    )
    qu = exact_quantiles(seen, keys, "u", {"x1": 0.03, "x2": 0.97})
    qv = exact_quantiles(seen, keys, "v", {"y1": 0.03, "y2": 0.97})
    ends = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("u").alias("_a"), F.min("v").alias("_b"),
        F.max("u").alias("_c"), F.max("v").alias("_d"),
    )
    q = qu.join(qv, keys).join(ends, keys)
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    lo_x, lo_y, hi_x, hi_y = (
        F.when(flat, F.col(f)).otherwise(F.col(t))
        for f, t in (("_a", "x1"), ("_b", "y1"), ("_c", "x2"), ("_d", "y2"))
    )
    box = rect_pad(lo_x, lo_y, hi_x, hi_y, F.col("_n"), width, height, 0.10, 12, 28, both_small=True)
    return q.select(*keys, *box.named())


def sole_pitch_bias(frames: DataFrame) -> DataFrame:
    """Median sole pitch of planted feet per run, limited and signed.

    ``frames``: run_id, frame_index, support, feet_visible, ``w9``, ``w10``,
    ``w15``, ``w17``, ``w18``, ``w20`` world points after the upright rotation.
    """
    from stridegrid.functions.pose import point, sole_pitch

    left = F.when(F.col("support").isin("left", "both"), sole_pitch(point(15), point(17)))
    right = F.when(F.col("support").isin("right", "both"), sole_pitch(point(18), point(20)))
    planted = frames.where("feet_visible").withColumns({"_l": left, "_r": right})
    feet = planted.select(
        "run_id", "frame_index", F.posexplode(F.array("_l", "_r")).alias("foot", "pitch")
    ).where("pitch IS NOT NULL")
    median = exact_quantiles(feet, ["run_id"], "pitch", {"median": 0.5}, floor_rank=True)
    counts = feet.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("frame_index").alias("_first")
    )
    limit, least = 0.3490658503988659, 0.02617993877991494  # fixed values: 20 and 1.5 degrees
    size = F.least(F.abs("median"), F.lit(limit))
    # a turn about the horizontal hip axis by +size or -size: keep what flattens the sole
    hips = point(10) - point(9)
    n = norm2(hips.x, hips.y)
    ax, ay = hips.x / n, hips.y / n
    rep = frames.join(counts.withColumnRenamed("_first", "frame_index"), ["run_id", "frame_index"])
    rep = rep.join(median, "run_id").withColumns({"_size": size, "_ax": ax, "_ay": ay, "_hip": n})

    def pitch_after(sign: float) -> Column:
        def turned(toe: int, heel: int) -> Column:
            s = point(toe) - point(heel)
            c, q = F.cos("_size"), F.sin(F.col("_size") * sign)
            along = (F.col("_ax") * s.x + F.col("_ay") * s.y) * (1 - c)
            x = s.x * c + F.col("_ay") * s.z * q + F.col("_ax") * along
            y = s.y * c - F.col("_ax") * s.z * q + F.col("_ay") * along
            z = s.z * c + (F.col("_ax") * s.y - F.col("_ay") * s.x) * q
            flat = norm2(x, y)
            return F.when(flat >= 0.05, F.abs(F.atan2(z, flat)))

        return F.coalesce(turned(15, 17), turned(18, 20), F.lit(float("inf")))

    sign = F.when(pitch_after(1.0) <= pitch_after(-1.0), 1.0).otherwise(-1.0)
    usable = (F.col("_n") >= 10) & (F.abs("median") >= least) & (F.col("_hip") > 1e-4)
    fixed = rep.select("run_id", F.when(usable, F.col("_size") * sign).otherwise(0.0).alias("sole_fix"))
    runs = frames.select("run_id").distinct()
    return runs.join(fixed, "run_id", "left").select(
        "run_id", F.coalesce("sole_fix", F.lit(0.0)).alias("sole_fix")
    )


def world_anchor(frames: DataFrame) -> DataFrame:
    """Anchor of a run: 97th percentile of y and means of x and z of its first present frame."""
    first = frames.where("subject_present").groupBy("run_id").agg(
        F.min(F.struct("frame_index", "joints"))["joints"].alias("joints")
    )
    pts = first.select("run_id", F.explode("joints").alias("j")).select(
        "run_id", F.col("j")[0].alias("x"), F.col("j")[1].alias("y"), F.col("j")[2].alias("z")
    )
    base = pts.groupBy("run_id").agg(F.avg("x").alias("centre_x"), F.avg("z").alias("centre_z"))
    return base.join(exact_quantiles(pts, ["run_id"], "y", {"floor_y": 0.97}), "run_id")


# Ground percentiles tried, in percent.
GROUND_LEVELS = (0.5, 1.0, 1.5, 2.5, 3.5)


def ground_calibration(
    points: DataFrame, first_frames: int = 45, default: float = 1.5
) -> DataFrame:
    """Ground percentile with a calm shift, and the shift of every frame.

    ``points``: run_id, frame_index, z. Over the first frames the mean step of
    the shift is taken for each percentile; from then on the lowest one within
    1.35 of the calmest is used, before that the default.
    """
    warm = max(8, first_frames)
    names = {f"l{i}": q for i, q in enumerate(GROUND_LEVELS)}
    asked = {**{k: q / 100 for k, q in names.items()}, "ldef": default / 100}
    per_frame = exact_quantiles(points, ["run_id", "frame_index"], "z", asked)
    early = per_frame.where(F.col("frame_index") < warm)
    moved = neighbourhood(
        early, RUNS, 1, lambda w: {f"_{k}": F.abs(F.col(k) - F.lag(k).over(w)) for k in names}
    )
    jitter = moved.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(f"_{k}").alias(f"_{k}") for k in names]
    )
    calm = F.least(*[F.col(f"_{k}") for k in names]) * 1.35 + 1e-9
    pick = F.coalesce(*[F.when(F.col(f"_{k}") <= calm, q) for k, q in names.items()])
    chosen = jitter.where(F.col("_n") >= warm).select("run_id", pick.alias("percentile"))
    shift = F.coalesce(*[F.when(F.col("percentile") == q, F.col(k)) for k, q in names.items()])
    ready = F.col("percentile").isNotNull() & (F.col("frame_index") >= warm - 1)
    return per_frame.join(chosen, "run_id", "left").select(
        "run_id", "frame_index", "percentile", (-F.when(ready, shift).otherwise(F.col("ldef"))).alias("ground_shift")
    )


def identity_counters(df: DataFrame, line: Line = RUNS) -> DataFrame:
    """Counters of a lock: losses, absent frames, reacquisitions, holds."""
    gone = F.col("status").isin("absent", "lost_hold")
    out = neighbourhood(
        df.withColumn("_gone", gone), line, 1,
        lambda w: {"_was": F.coalesce(F.lag("_gone").over(w), F.lit(False))},
    )
    count = lambda c: F.sum(c.cast("long"))
    return out.groupBy(*line.keys).agg(
        count(F.col("_gone") & ~F.col("_was")).alias("lost_events"),
        count(F.col("_gone")).alias("absent_frames"),
        count(~F.col("_gone") & F.col("_was")).alias("reacquired"),
        count(F.col("status") == "occluded").alias("occlusion_holds"),
        count(F.col("_gone")).alias("blocked_switches"),
    )


def timing_summary(records: DataFrame, stages: list[str], keys: list[str]) -> DataFrame:
    """Total milliseconds and milliseconds per frame of each stage."""
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.sum(s).alias(f"{s}_total") for s in stages],
        *[(F.sum(s) / F.count(F.lit(1))).alias(f"{s}_per_frame") for s in stages],
    )


def observed_timings(records: DataFrame, stages: list[str]) -> tuple[DataFrame, Observation]:
    """``records`` as they are, and totals that the first action over them gathers on its way, without a pass of its own.

    ``timing_row`` reads them once that action is done.
    """
    seen = Observation()
    sums = [F.sum(s).alias(f"{s}_total") for s in stages]
    return records.observe(seen, F.count(F.lit(1)).alias("frames"), *sums), seen


def timing_row(spark: SparkSession, seen: Observation, stages: list[str]) -> DataFrame:
    """One row as ``timing_summary`` gives it for a key; totals of no rows are null."""
    told = seen.get
    kinds = "frames bigint, " + ", ".join(f"{s}_total double" for s in stages)
    values = [None if (v := told.get(f"{s}_total")) is None else float(v) for s in stages]
    row = spark.createDataFrame([(told["frames"], *values)], kinds)
    return row.withColumns({f"{s}_per_frame": F.try_divide(f"{s}_total", "frames") for s in stages})


def max_joint_count(frames: DataFrame) -> DataFrame:
    return frames.groupBy("run_id").agg(F.coalesce(F.max(F.size("joints")), F.lit(0)).alias("joint_count"))


def crossing_metrics(df: DataFrame, line: Line = RUNS) -> DataFrame:
    """Switches, share and end of a track against the true subject.

    ``df``: keys, position, present, label (person under the box), truth.
    """
    known = F.when(F.col("present"), F.col("label"))
    out = running(df, line, _before=("prev", known))
    on = F.col("present") & (F.col("label") == F.col("truth"))
    return out.groupBy(*line.keys).agg(
        F.sum((F.col("present") & F.col("_before").isNotNull() & (F.col("_before") != F.col("label"))).cast("long")).alias("switches"),
        (F.sum(on.cast("double")) / F.sum(F.col("present").cast("double"))).alias("on_subject"),
        F.max(F.struct(F.col(line.pos), F.coalesce(on, F.lit(False)).alias("on")))["on"].alias("ended_on_subject"),
        F.avg(F.col("present").cast("double")).alias("present_ratio"),
    )


def choose_candidate(
    cands: DataFrame, keys: list[str], strategy: str, width: float, height: float
) -> DataFrame:
    """Best candidate per key; the first in input order on a tie."""
    b = Box.of()
    area = (b.x2 - b.x1) * (b.y2 - b.y1)
    rank = {
        "patient": -candidate_score(b, width, height, F.col("score")),
        "largest": -area,
        "leftmost": b.x1,
        "rightmost": -b.x2,
        "center": F.abs(b.cx - width * 0.5),
        "tightest": area,
    }[strategy]
    best = F.min(F.struct(rank.alias("r"), "det_id", "x1", "y1", "x2", "y2"))
    return cands.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, "_b.det_id", "_b.x1", "_b.y1", "_b.x2", "_b.y2"
    )


def padded_range(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Plot range of a series: 8 % padding, constant series widened, empty 0 to 1."""
    v = finite_or_null(F.col(value))
    out = df.groupBy(*keys).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    span = F.col("_b") - F.col("_a")
    grow = F.when(span > 0, span * 0.08).otherwise(
        F.when(F.abs("_a") > 1e-9, F.abs("_a") * 0.1).otherwise(1.0)
    )
    return out.select(
        *keys,
        F.coalesce(F.col("_a") - grow, F.lit(0.0)).alias("low"),
        F.coalesce(F.col("_b") + grow, F.lit(1.0)).alias("high"),
    )


def tracking_confidence(
    cands: DataFrame, keys: list[str], present: str = "present", margin: float = 0.08
) -> DataFrame:
    """Margin of the two best rewards per frame as confidence and ambiguity flag."""
    top = cands.groupBy(*keys).agg(
        F.max("reward").alias("_r1"), F.count("reward").alias("_n"), F.max(present).alias("_p")
    )
    second = (
        cands.join(top.select(*keys, "_r1"), keys)
        .groupBy(*keys)
        .agg(
            F.sum((F.col("reward") == F.col("_r1")).cast("int")).alias("_ties"),
            F.max(F.when(F.col("reward") < F.col("_r1"), F.col("reward"))).alias("_below"),
        )
    )
    joined = top.join(second, keys)
    runner = F.when(F.col("_ties") > 1, F.col("_r1")).otherwise(F.col("_below"))
    gap = F.when(F.col("_n") >= 2, F.col("_r1") - runner).otherwise(
        F.greatest(F.col("_r1"), F.lit(0.08))
    )
    return joined.select(
        *keys,
        F.when(F.col("_p"), clip(gap / 0.16, 0.0, 1.0)).otherwise(0.0).alias("confidence"),
        (F.col("_p") & (F.col("_n") >= 2) & (gap < margin)).alias("ambiguous"),
    )
