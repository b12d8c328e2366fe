"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridegrid.functions.numbers import tidy
from stridegrid.operators.recurrences import ONE_EURO
from stridegrid.plans import window_queries
from stridegrid.plans.registry import STATUS, query
from stridegrid.sources import adapters as A
from stridegrid.sources.writers import shared_folder
from stridegrid.streaming import live as L
from stridegrid.streaming import sinks as K
from stridegrid.streaming.anchors import anchor_stream
from stridegrid.streaming.filters import one_euro_stream
from stridegrid.streaming.segments import end_rows, segment_stream


_HOURS = """SELECT user_id AS run_id, epoch(date_trunc('hour', ts))::BIGINT AS window_start, count(*) AS n FROM events GROUP BY ALL"""
_SESSIONS = """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 7200 THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id AS run_id, floor(epoch(min(ts)))::BIGINT AS first_seen, floor(epoch(max(ts)))::BIGINT AS last_seen, count(*) AS n FROM s GROUP BY user_id, sid"""


def _event_stream(spark, sf, *columns):
    """Events as a stream; a pattern, as a stream reads folders or patterns."""
    held = A.table(spark, sf, "events")
    stream = spark.readStream.schema(held.schema).parquet(f"{sf}/[e]vents.parquet")
    return stream.select(*columns, F.col("ts").cast("timestamp"))


def _closed(spark, stream, sf, after):
    """The stream of events with a row that closes its windows."""
    path = shared_folder(spark, "close")
    rows = A.table(spark, sf, "events").withColumnRenamed("user_id", "run_id")
    K.write_close(rows.select("run_id", F.col("ts").cast("timestamp").alias("ts")), path, "ts", after)
    return K.with_close(stream, path)


def _drained(spark, stream, name):
    return K.drained(stream, shared_folder(spark, name), shared_folder(spark, f"{name}-state"))


@query("windowed_stream", "T8", _HOURS)
def windowed_stream(spark, sf):
    e = _closed(spark, _event_stream(spark, sf, F.col("user_id").alias("run_id")), sf, "1 day")
    out = _drained(spark, L.windowed_counts(e, ["run_id"], wait="10 minutes"), "windows")
    return out.withColumn("window_start", F.unix_timestamp("window_start"))


@query("session_stream", "T8", _SESSIONS)
def session_stream(spark, sf):
    e = _closed(spark, _event_stream(spark, sf, F.col("user_id").alias("run_id")), sf, "1 day")
    out = _drained(spark, L.absence_sessions(e, ["run_id"], gap="2 hours", wait="10 minutes"), "sessions")
    return out.withColumns({c: F.unix_timestamp(c) for c in ("first_seen", "last_seen")})


@query("live_snapshot", "S14", """SELECT user_id AS run_id, event_type, count(*)::BIGINT AS "rows", min(event_id) AS first_event_id, max(event_id) AS last_event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def live_snapshot(spark, sf):
    held = A.table(spark, sf, "events")
    stream = spark.readStream.schema(held.schema).parquet(f"{sf}/[e]vents.parquet")
    rows = stream.select(F.col("user_id").alias("run_id"), "event_type", "event_id", "value")
    path, keys = shared_folder(spark, "snapshot"), ["run_id", "event_type"]
    K.write_snapshots(rows, keys, "event_id", path, shared_folder(spark, "snapshot-state")).awaitTermination()
    return K.snapshot(spark.read.parquet(path), keys, "event_id")


@query("anchor_stream", "T5", f"""WITH {STATUS}, nx AS (SELECT a.run_id, a.frame_index AS afr, min(s.frame_index) AS frame_index FROM status a JOIN status s ON s.run_id = a.run_id AND s.frame_index >= a.frame_index AND s.event_id % 2 = 0 WHERE a.ambiguous GROUP BY ALL),
ls AS (SELECT run_id, frame_index, max(afr) AS anchor_frame FROM nx GROUP BY ALL)
SELECT s.run_id, s.frame_index, ls.anchor_frame FROM status s LEFT JOIN ls USING (run_id, frame_index) WHERE s.event_id % 2 = 0""")
def anchor_stream_query(spark, sf):
    s = A.status(spark, sf)
    path = shared_folder(spark, "frames")
    s.where("event_id % 2 = 0").select("run_id", "frame_index").write.parquet(path)
    stream = spark.readStream.schema("run_id bigint, frame_index bigint").parquet(path)
    anchors = s.where("ambiguous").select("run_id", "frame_index", F.col("frame_index").alias("anchor_frame"))
    return _drained(spark, anchor_stream(stream, anchors), "anchors")


@query("one_euro_stream", "G3", window_queries.ONE_EURO_SQL)
def one_euro_stream_query(spark, sf):
    path = shared_folder(spark, "samples")
    A.series(spark, sf).select("run_id", "frame_index", (F.col("value") / 100).alias("v")).write.parquet(path)
    stream = spark.readStream.schema("run_id bigint, frame_index bigint, v double").option("maxFilesPerTrigger", 10_000).parquet(path)
    out = _drained(spark, one_euro_stream(stream, 30.0, {"smooth": ("v", *ONE_EURO["x"])}), "smoothed")
    return out.withColumn("smooth", tidy(F.col("smooth")))


@query("segment_stream", "T2,J7")
def segment_stream_query(spark, sf):
    from stridegrid.plans.tracking_queries import montage

    dets = montage(spark, sf)
    path = shared_folder(spark, "detections")
    dets.unionByName(end_rows(dets)).write.parquet(path)
    stream = spark.readStream.schema(dets.schema).parquet(path)
    return _drained(spark, segment_stream(stream, 2), "segments")


@query("windowed_counts", "T8", _HOURS)
def windowed_counts(spark, sf):
    e = A.table(spark, sf, "events").withColumnRenamed("user_id", "run_id")
    return L.windowed_counts(e, ["run_id"]).withColumn("window_start", F.unix_timestamp("window_start"))


@query("sliding_counts", "T8", """SELECT event_type, w AS window_start, count(*) AS n FROM (SELECT event_type, epoch(ts) AS t, unnest([floor(epoch(ts) / 1800) * 1800, floor(epoch(ts) / 1800) * 1800 - 1800])::BIGINT AS w FROM events) GROUP BY ALL""")
def sliding_counts(spark, sf):
    e = A.table(spark, sf, "events")
    return L.windowed_counts(e, ["event_type"], width="1 hour", slide="30 minutes").withColumn(
        "window_start", F.unix_timestamp("window_start")
    )


@query("absence_sessions", "T8", _SESSIONS)
def absence_sessions(spark, sf):
    e = A.table(spark, sf, "events").withColumnRenamed("user_id", "run_id")
    out = L.absence_sessions(e, ["run_id"], gap="2 hours")
    return out.withColumns({c: F.unix_timestamp(c) for c in ("first_seen", "last_seen")})


@query("live_progress", "T6", f"""WITH {STATUS} SELECT run_id, count(*) AS frames, (floor((max(frame_index) + 1) / 10.0) * 10)::BIGINT AS reported_to, count(*) FILTER (present) AS present FROM status GROUP BY run_id""")
def live_progress(spark, sf):
    return L.progress(A.status(spark, sf), "run_id", 10)


@query("deduplicated_frames", "T7", """SELECT user_id AS run_id, event_id, event_type FROM events""")
def deduplicated_frames(spark, sf):
    kind = A.table(spark, sf, "events").schema
    # a pattern, as a stream reads folders or patterns
    stream = spark.readStream.schema(kind).parquet(f"{sf}/[e]vents.parquet")
    e = stream.select(F.col("user_id").alias("run_id"), "event_id", "event_type", F.col("ts").cast("timestamp"))
    once = L.late_frames(e.unionByName(e.where("event_id % 3 = 0")), ["run_id", "event_id"])
    path, checkpoint = shared_folder(spark, "frames"), shared_folder(spark, "frames-state")
    rows = once.select("run_id", "event_id", "event_type")
    writing = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writing.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)
