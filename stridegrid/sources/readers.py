"""Readers: run documents, detection lines, anchors, ranges, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridegrid.functions.numbers import finite, numeric_or_default
from stridegrid.functions.pose import parse_joints, parse_triplet
from stridegrid.sources.schemas import DETECTION_LINE, RECORD, RUN_DOC


def _is_object(text: Column) -> Column:
    return F.ltrim(text).startswith("{")


def runs_and_frames(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``runs`` and ``frames`` of parsed run documents (run_id plus ``RUN_DOC``)."""
    fps = F.coalesce(F.col("fps_output"), F.col("fps"))
    runs = docs.select(
        "run_id",
        F.coalesce("source_video", "video_input").alias("source_video"),
        numeric_or_default(fps, 30.0).alias("fps"),
        F.col("video_width").alias("width"),
        F.col("video_height").alias("height"),
        F.when(F.col("inference_target") == "hand", "hand").otherwise("body").alias("inference_target"),
        F.coalesce(
            "total_frames_processed", F.when(F.col("records").isNotNull(), F.size("records")), F.lit(0)
        ).alias("frame_count"),
        F.col("camera_motion_compensation.shift_px_step_mean_small").alias("camera_shift_px"),
        "subject",
        "created_at",
        "updated_at",
    )
    kept = F.filter("records", lambda t: t.isNotNull() & _is_object(t))
    rows = docs.select("run_id", F.posexplode(kept).alias("_pos", "_text"))
    rec = rows.select("run_id", "_pos", F.from_json("_text", RECORD).alias("r"))
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    frames = rec.select(
        "run_id",
        F.col("_pos").cast("long").alias("frame_index"),
        F.coalesce("r.video_frame", "_pos").alias("video_frame"),
        F.element_at(F.split("r.mesh_path", "/"), -1).alias("mesh_file"),
        "r.subject_present",
        "r.inference_status",
        "r.identity_is_lost",
        F.coalesce("r.subject_tracking_status", "r.identity_lock_status").alias("tracking_status"),
        parse_triplet(F.col("r.camera_comp_cam_xyz"), zero).alias("camera_comp"),
        F.coalesce(
            parse_joints(F.col("r.joints_cam_xyz")), parse_joints(F.col("r.joints_space_cam_xyz"))
        ).alias("joints"),
        F.col("r.bbox_xyxy").alias("bbox"),
        "r.focal_length",
        "r.identity_gallery_similarity",
        F.col("r.identity_stability_score").alias("stability"),
    )
    return runs, frames


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read ``<path>/<run_id>/*.json`` run documents, one object per file."""
    docs = (
        spark.read.schema(RUN_DOC)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(path)
        .withColumn(
            "run_id",
            F.coalesce("run_id", F.element_at(F.split(F.input_file_name(), "/"), -2)),
        )
    )
    return runs_and_frames(docs)


def parse_runs(texts: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Run documents held as text, one per row next to ``run_id``."""
    docs = texts.where(_is_object(F.col(column))).select(
        F.col("run_id").alias("_rid"), F.from_json(column, RUN_DOC).alias("d")
    )
    return runs_and_frames(docs.select("_rid", "d.*").drop("run_id").withColumnRenamed("_rid", "run_id"))


def read_detection_stream(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Detections of JSON lines, one line per frame; malformed lines are skipped."""
    reader = (spark.readStream if streaming else spark.read).schema(DETECTION_LINE)
    lines = reader.option("mode", "DROPMALFORMED").json(path)
    return detections_of(lines)


def detections_of(lines: DataFrame) -> DataFrame:
    exploded = lines.where(F.col("f").isNotNull()).select("f", "t", F.explode("dets").alias("d"))
    return exploded.where(F.size("d.b") >= 4).select(
        F.col("f").alias("frame"),
        "t",
        F.col("d.id").alias("track_id"),
        *[F.col("d.b")[i].alias(n) for i, n in enumerate(("x", "y", "w", "h"))],
        F.coalesce("d.s", F.lit(1.0)).alias("score"),
    )


def read_incremental(df: DataFrame, since: int, cursor: str = "frame") -> DataFrame:
    """Rows at or past the cursor; on parquet the filter reaches the scan."""
    return df.where(F.col(cursor) >= since)


def _anchors(frames_map: Column) -> Column:
    return F.filter(
        F.transform(
            F.map_entries(frames_map),
            lambda e: F.struct(
                e["key"].try_cast("int").alias("frame_index"),
                F.from_json(e["value"], "array<double>").alias("bbox"),
            ),
        ),
        lambda a: F.coalesce(
            (a["frame_index"] >= 0) & (F.size(a["bbox"]) == 4) & F.forall(a["bbox"], lambda v: v.isNotNull()),
            F.lit(False),
        ),
    )


def read_subject_tracks(texts: DataFrame, key: str = "run_id", column: str = "text") -> DataFrame:
    """Anchors of chosen-subject documents: several subjects or the older single one."""
    subject = "struct<subjectId string, label string, color string, frames map<string,string>>"
    doc = F.from_json(column, f"struct<subjects array<{subject}>, frames map<string,string>>")
    parsed = texts.select(key, doc.alias("d"))
    single = F.array(
        F.struct(
            F.lit("0").alias("subjectId"), F.lit("1").alias("label"), F.lit("").alias("color"),
            F.col("d.frames").alias("frames"),
        )
    )
    subjects = F.when(F.col("d.subjects").isNotNull(), F.col("d.subjects")).otherwise(single)
    with_anchors = F.filter(
        F.transform(
            subjects,
            lambda s, i: F.struct(
                F.coalesce(s["subjectId"], i.cast("string")).alias("subject_id"),
                s["label"].alias("label"),
                F.coalesce(s["color"], F.lit("")).alias("color"),
                _anchors(s["frames"]).alias("anchors"),
            ),
        ),
        lambda s: F.coalesce(F.size(s["anchors"]) > 0, F.lit(False)),
    )
    rows = parsed.select(key, F.posexplode(with_anchors).alias("subject_index", "s"))
    return rows.select(
        key,
        "subject_index",
        "s.subject_id",
        F.coalesce("s.label", (F.col("subject_index") + 1).cast("string")).alias("label"),
        "s.color",
        F.explode("s.anchors").alias("a"),
    ).select(key, "subject_index", "subject_id", "label", "color", "a.frame_index", "a.bbox")


def read_prompt_anchors(texts: DataFrame, key: str = "run_id", column: str = "text") -> DataFrame:
    """Anchors of a JSON list; several spellings, invalid items skipped."""
    items = F.from_json(column, "array<string>")
    fields = "frameIndex string, frame string, frame_index string, bbox string, box string"
    rows = texts.select(key, F.explode(items).alias("t")).where(_is_object(F.col("t")))
    rows = rows.select(key, F.from_json("t", fields).alias("i"))
    out = rows.select(
        key,
        F.coalesce("i.frameIndex", "i.frame", "i.frame_index").try_cast("double").cast("int").alias("frame_index"),
        F.from_json(F.coalesce("i.bbox", "i.box"), "array<double>").alias("bbox"),
    )
    valid = (F.col("frame_index") >= 0) & (F.size("bbox") == 4) & F.forall("bbox", lambda v: v.isNotNull())
    return out.where(valid)


def read_timeline_ranges(texts: DataFrame, key: str = "run_id", column: str = "text") -> DataFrame:
    """Ranges written as ``a-b,c-d`` or as a JSON list of pairs."""
    text = F.trim(F.col(column))
    is_json = text.startswith("[")
    chunks = F.transform(
        F.split(text, ","),
        lambda c: F.struct(
            F.trim(F.substring_index(c, "-", 1)).try_cast("double").alias("start_sec"),
            F.when(c.contains("-"), F.trim(F.regexp_replace(c, "^[^-]*-", "")).try_cast("double")).alias("end_sec"),
        ),
    )
    pairs = F.transform(
        F.from_json(text, "array<array<double>>"),
        lambda p: F.struct(F.get(p, F.lit(0)).alias("start_sec"), F.get(p, F.lit(1)).alias("end_sec")),
    )
    plain = texts.where(~is_json).select(key, F.explode(chunks).alias("r")).select(key, "r.*")
    listed = texts.where(is_json).select(key, F.explode(pairs).alias("r")).select(key, "r.*")
    ok_plain = finite(F.col("start_sec")) & finite(F.col("end_sec")) & (F.col("start_sec") >= 0)
    later = F.col("end_sec") > F.col("start_sec")
    return plain.where(ok_plain & later).unionByName(
        listed.where(later).withColumn("start_sec", F.greatest(F.lit(0.0), F.col("start_sec")))
    )


def list_runs(manifests: DataFrame) -> DataFrame:
    """One summary row per run id, newest first; old spellings are accepted.

    Only summary columns are read, never the per-frame records.
    """
    have = set(manifests.columns)

    def first_of(*names: str, cast: str = "string") -> Column:
        found = [F.col(n).cast(cast) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast(cast)

    rows = manifests.where(F.col("run_id").isNotNull()).select(
        "run_id",
        F.greatest(
            F.lit(0),
            F.coalesce(
                first_of("processed_frames", "processedFrames", "frame_count", "total_frames_processed", cast="int"),
                F.lit(0),
            ),
        ).alias("processed_frames"),
        first_of("fps", "fps_output", cast="double").alias("fps"),
        first_of("updated_at").alias("updated_at"),
        first_of("created_at").alias("created_at"),
        F.when(first_of("inference_target") == "hand", "hand").otherwise("body").alias("inference_target"),
    )
    order = F.struct(F.coalesce("updated_at", F.lit("")), *[c for c in rows.columns if c != "run_id"])
    best = rows.groupBy("run_id").agg(F.max(order).alias("_b"))
    cols = [c for c in rows.columns if c != "run_id"]
    return best.select("run_id", *[F.col(f"_b.{c}") for c in cols]).orderBy(F.desc("updated_at"), "run_id")


def analysis_id(run_id: Column, preset: Column, params_json: Column) -> Column:
    """``<run>_<preset>_<10 hex of the sha1 of the parameters>``."""
    return F.concat_ws("_", run_id, preset, F.substring(F.sha1(params_json), 1, 10))


def select_analysis(manifests: DataFrame, wanted: str | None = None) -> DataFrame:
    """The asked analysis of each run, else the latest pointer, else the last entry."""
    last = F.element_at(F.col("analyses"), -1)["analysis_id"]
    pointer = F.when(F.col("latest_analysis_id") != "", F.col("latest_analysis_id"))
    return manifests.select(
        "run_id",
        F.coalesce(F.lit(wanted), pointer, F.when(F.size("analyses") > 0, last)).alias("analysis_id"),
    )
