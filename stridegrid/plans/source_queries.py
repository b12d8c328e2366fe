"""Queries over sources and sinks; documents are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridegrid.functions.numbers import tidy
from stridegrid.operators.frames import absent_records
from stridegrid.operators.signals import to_long
from stridegrid.plans.registry import BOXES, SERIES, SPANS, STATUS, query, r
from stridegrid.sources import adapters as A
from stridegrid.sources import readers as RD
from stridegrid.sources import writers as WR

RUN = ["run_id", "frame_index"]


def _run_docs(spark, sf):
    o = A.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 10 == 9, F.lit("[1, 2]")).otherwise(
        F.concat(
            F.lit('{"video_input": "v'), k.cast("string"), F.lit('.mp4", "fps_output": '),
            F.when(k % 4 == 0, "null").otherwise(F.concat(F.lit(""), (k % 50 + 10).cast("string"))),
            F.lit(', "inference_target": "hand", "records": [{"video_frame": '), (k % 100).cast("string"),
            F.lit(', "joints_cam_xyz": [[1, 2, '), (k % 7).cast("string"),
            F.lit('], [4, 5, 6]], "mesh_path": "a/b/m.ply", "identity_stability_score": 0.5}, 7, "x", {"subject_present": false, "joints_cam_xyz": [[1, 2]], "joints_space_cam_xyz": [[9, 8, 7]]}]}'),
        )
    )
    return o.select(k.alias("run_id"), text.alias("text"))


@query("run_documents", "S1,P2", """SELECT o_orderkey AS run_id, 'v' || o_orderkey || '.mp4' AS source_video, CASE WHEN o_orderkey % 4 = 0 THEN 30.0 ELSE (o_orderkey % 50 + 10)::DOUBLE END::DOUBLE AS fps, 'hand' AS inference_target, 4::INT AS frame_count FROM orders WHERE o_orderkey % 10 <> 9""")
def run_documents(spark, sf):
    runs, _ = RD.parse_runs(_run_docs(spark, sf))
    return runs.select("run_id", "source_video", "fps", "inference_target", "frame_count")


@query("run_records", "S1,P2", """SELECT o_orderkey AS run_id, unnest([0, 1])::BIGINT AS frame_index, unnest([(o_orderkey % 100)::BIGINT, 1])::INT AS video_frame, unnest(['m.ply', NULL]) AS mesh_file, unnest([2, 1])::INT AS joints, unnest([(o_orderkey % 7)::DOUBLE, 7.0]) AS first_z, unnest([0.5, NULL])::DOUBLE AS stability FROM orders WHERE o_orderkey % 10 <> 9""")
def run_records(spark, sf):
    _, frames = RD.parse_runs(_run_docs(spark, sf))
    return frames.select(
        *RUN, "video_frame", "mesh_file", F.size("joints").alias("joints"),
        F.get(F.get("joints", F.lit(0)), F.lit(2)).alias("first_z"), "stability",
    )


def _lines(spark, sf):
    e = A.table(spark, sf, "events")
    i = F.col("event_id")
    text = F.when(i % 13 == 0, F.lit('{"f": 3, "dets": [')).otherwise(
        F.concat(
            F.lit('{"f":'), i.cast("string"), F.lit(',"t":0.5,"dets":[{"id":'), (i % 5).cast("string"),
            F.lit(',"b":[0.1,0.2,0.3,0.4],"s":0.75},{"id":9,"b":[0.1,0.2]}]}'),
        )
    )
    return e.select(text.alias("value"))


@query("detection_lines_read", "S2", """SELECT event_id AS frame, 0.5::DOUBLE AS t, event_id % 5 AS track_id, 0.3::DOUBLE AS w, 0.75::DOUBLE AS score FROM events WHERE event_id % 13 <> 0""")
def detection_lines_read(spark, sf):
    path = WR.shared_folder(spark, "lines")
    _lines(spark, sf).write.text(path)
    return RD.read_detection_stream(spark, path).select("frame", "t", "track_id", "w", "score")


@query("incremental_read", "S3", f"WITH {BOXES} SELECT video_id, frame, det_id FROM boxes WHERE frame >= 150")
def incremental_read(spark, sf):
    return RD.read_incremental(A.boxes(spark, sf), 150).select("video_id", "frame", "det_id")


@query("subject_tracks_read", "S4", """WITH d AS (SELECT o_orderkey AS run_id, o_orderkey % 3 AS m, o_orderkey % 60 AS k FROM orders)
SELECT run_id, 0::INT AS subject_index, 'a' AS subject_id, '1' AS label, '#fff' AS color, k::INT AS frame_index, 3.5::DOUBLE AS x2 FROM d WHERE m = 0
UNION ALL SELECT run_id, 1, '2', 'two', '', (k + 1)::INT, 7.0 FROM d WHERE m = 0
UNION ALL SELECT run_id, 0, '0', '1', '', k::INT, 9.0 FROM d WHERE m = 1""")
def subject_tracks_read(spark, sf):
    k = F.col("o_orderkey")
    f, g = (k % 60).cast("string"), (k % 60 + 1).cast("string")
    many = F.concat(
        F.lit('{"subjects": [{"subjectId": "a", "color": "#fff", "frames": {"'), f, F.lit('": [1, 2, 3.5, 4], "-4": [1, 2, 3, 4], "x": [1, 2, 3, 4], "7": [1, 2]}}, {"frames": {}}, {"label": "two", "frames": {"'),
        g, F.lit('": [5, 6, 7, 8]}}]}'),
    )
    one = F.concat(F.lit('{"frames": {"'), f, F.lit('": [1, 2, 9, 4]}}'))
    text = F.when(k % 3 == 0, many).when(k % 3 == 1, one).otherwise(F.lit("not json"))
    docs = A.table(spark, sf, "orders").select(k.alias("run_id"), text.alias("text"))
    out = RD.read_subject_tracks(docs)
    return out.select("run_id", "subject_index", "subject_id", "label", "color", "frame_index", F.col("bbox")[2].alias("x2"))


@query("prompt_anchors_read", "S5", """WITH d AS (SELECT o_orderkey AS run_id, (o_orderkey % 60)::INT AS k FROM orders)
SELECT run_id, k AS frame_index, 4.0::DOUBLE AS y2 FROM d UNION ALL SELECT run_id, k + 1, 8.0 FROM d UNION ALL SELECT run_id, k + 2, 2.0 FROM d""")
def prompt_anchors_read(spark, sf):
    k = F.col("o_orderkey") % 60
    s = lambda d: (k + d).cast("string")
    text = F.concat(
        F.lit('[{"frameIndex": '), s(0), F.lit(', "bbox": [1, 2, 3, 4]}, {"frame": "'), s(1), F.lit('", "box": [5, 6, 7, 8]}, {"frame_index": '),
        s(2), F.lit(', "bbox": [0, 0, 1, 2]}, {"frame": -1, "bbox": [1, 2, 3, 4]}, {"frame": 5, "bbox": [1, 2, 3]}, {"bbox": [1, 2, 3, 4]}, 5]'),
    )
    docs = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), text.alias("text"))
    return RD.read_prompt_anchors(docs).select("run_id", "frame_index", F.col("bbox")[3].alias("y2"))


@query("timeline_ranges_read", "S6", f"""WITH {SPANS}
SELECT order_id AS run_id, start_sec, end_sec FROM spans WHERE order_id % 2 = 0 AND end_sec > start_sec UNION ALL SELECT order_id, 1.5, 2.5 FROM spans WHERE order_id % 2 = 0
UNION ALL SELECT order_id, 0.0, end_sec FROM spans WHERE order_id % 2 = 1""")
def timeline_ranges_read(spark, sf):
    s = A.spans(spark, sf)
    plain = F.concat(F.col("start_sec").cast("string"), F.lit("-"), F.col("end_sec").cast("string"), F.lit(", 1.5-2.5, x-3, 9, 5-4"))
    listed = F.concat(F.lit("[[-3, "), F.col("end_sec").cast("string"), F.lit("], [4, 4], [5]]"))
    docs = s.select(F.col("order_id").alias("run_id"), F.when(F.col("order_id") % 2 == 0, plain).otherwise(listed).alias("text"))
    return RD.read_timeline_ranges(docs)


def _wide_source(spark, sf):
    s = A.series(spark, sf).withColumns(
        {"video_frame": F.col("frame_index") * 2, "mesh_file": F.lit(None).cast("string"), "half": F.col("value") / 3}
    )
    return s


@query("kinematics_parquet", "S7", f"WITH {SERIES} SELECT run_id, frame_index, frame_index * 2 AS video_frame, {r('value')} AS whole, {r('value / 3')} AS third FROM series")
def kinematics_parquet(spark, sf):
    s = _wide_source(spark, sf)
    signals = to_long(s, {"value": "whole", "half": "third"})
    path = WR.shared_folder(spark, "kinematics")
    WR.write_kinematics_parquet(signals, s, ["whole", "third"], path)
    back = WR.read_kinematics(spark, path)
    return back.select(
        F.col("run_id").cast("long").alias("run_id"), "frame_index", "video_frame",
        tidy(F.col("whole")).alias("whole"), tidy(F.col("third")).alias("third"),
    )


@query("kinematics_csv", "S8", f"""WITH {SERIES}, c AS (SELECT run_id, frame_index::VARCHAR AS frame_index, (frame_index * 2)::VARCHAR AS video_frame, floor(frame_index * 2 / 30.0 * 1000 + 0.5)::BIGINT::VARCHAR AS timestamp_ms,
 CASE WHEN value IS NULL THEN '' WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE regexp_replace(printf('%.6f', value), '0+$', '') END AS "v.mm" FROM series)
SELECT * FROM c UNION ALL SELECT DISTINCT run_id, '', '', 'ms', 'mm' FROM c""")
def kinematics_csv(spark, sf):
    s = _wide_source(spark, sf).withColumn("v.mm", F.col("value"))
    return WR.kinematics_csv_rows(s, ["v.mm"], {"v.mm": "mm"}, 30.0).drop("_order")


@query("kinematics_json", "S9", """WITH p AS (SELECT label::BIGINT AS run_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding[1]::DOUBLE AS v, embedding[16]::DOUBLE AS sx FROM embeddings)
SELECT run_id, i AS frame_index, floor(i / 30.0 * 1000 + 0.5)::BIGINT AS ms, round(v + 3e-11, 6) AS v, round(sx + 3e-11, 6) AS shoulder_x, 21::INT AS n FROM p""")
def kinematics_json(spark, sf):
    p = A.pose(spark, sf).withColumns({"video_frame": F.col("frame_index"), "sig": F.get(F.get("joints", F.lit(0)), F.lit(0))})
    docs = WR.kinematics_json(p, ["sig"], 30.0)
    d = F.from_json("json", "struct<index long, timestampMs long, values map<string,double>, joints map<string,array<double>>>")
    return docs.select("run_id", d.alias("d")).select(
        "run_id", F.col("d.index").alias("frame_index"), F.col("d.timestampMs").alias("ms"),
        F.round(F.col("d.values")["sig"] + 3e-11, 6).alias("v"),
        F.round(F.col("d.joints")["left_shoulder"][0] + 3e-11, 6).alias("shoulder_x"), F.size("d.joints").alias("n"),
    )


@query("analysis_artifacts", "S10,S16", f"""WITH {SERIES} SELECT run_id, frame_index, {r('value')} AS value, run_id || '_default_' || substr(sha1('{{"preset": "default"}}'), 1, 10) AS analysis_id, 'default' AS preset FROM series""")
def analysis_artifacts(spark, sf):
    s = A.series(spark, sf).select(*RUN, "value")
    ids = s.select("run_id").distinct().select(
        "run_id",
        RD.analysis_id(F.col("run_id").cast("string"), F.lit("default"), F.lit('{"preset": "default"}')).alias("analysis_id"),
        F.lit("default").alias("preset"),
    )
    path = WR.shared_folder(spark, "analysis")
    WR.write_analysis({"signals": s}, ids, path)
    back = WR.read_analysis(spark, path, "signals")
    return back.select(*RUN, tidy(F.col("value")).alias("value"), "analysis_id", "preset")


@query("upsert_analysis", "S11", """WITH o AS (SELECT o_custkey AS run_id, 'a' || (o_orderkey % 5) AS analysis_id, max(o_totalprice) AS score FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), n AS (SELECT o_custkey AS run_id, 'a' || (o_orderkey % 5) AS analysis_id, min(o_totalprice) AS score FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.run_id = o.run_id AND n.analysis_id = o.analysis_id)""")
def upsert_analysis(spark, sf):
    o = A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.concat(F.lit("a"), (F.col("o_orderkey") % 5).cast("string")).alias("analysis_id"), "o_orderkey", "o_totalprice"
    )
    old = o.where("o_orderkey % 2 = 0").groupBy("run_id", "analysis_id").agg(F.max("o_totalprice").alias("score"))
    new = o.where("o_orderkey % 3 = 0").groupBy("run_id", "analysis_id").agg(F.min("o_totalprice").alias("score"))
    return WR.upsert_analysis(old, new)


_NEW = """an AS (SELECT o_custkey AS run_id, 'a' || (o_orderkey % 5) AS analysis_id, max(strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderkey) AS made FROM orders GROUP BY ALL),
old AS (SELECT * FROM an WHERE analysis_id IN ('a0', 'a1', 'a2')), fresh AS (SELECT run_id, analysis_id, made || '+' AS made FROM an WHERE analysis_id IN ('a2', 'a3') AND run_id % 3 <> 0),
all_ AS (SELECT run_id, analysis_id, made, 1 AS turn FROM fresh UNION ALL SELECT run_id, analysis_id, made, 0 FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh WHERE fresh.run_id = old.run_id AND fresh.analysis_id = old.analysis_id))"""


@query("recorded_analyses", "S11,S12", f"""WITH {_NEW}, g AS (SELECT run_id, list(analysis_id ORDER BY turn, made, analysis_id) AS ids, list(made ORDER BY turn, made, analysis_id) AS ats FROM all_ GROUP BY run_id)
SELECT r.run_id, coalesce(len(ids), 0) AS analyses, coalesce(array_to_string(ids, ','), '') AS ids, ids[-1] AS latest_analysis_id, '{{"ok":"' || ats[-1] || '"}}' AS quality_summary, coalesce(ats[-1], 'start') AS updated_at, 'analysis/' || ids[-1] || '/qa.json' AS qa_file
FROM (SELECT DISTINCT o_custkey AS run_id FROM orders) r LEFT JOIN g USING (run_id)""")
def recorded_analyses(spark, sf):
    o = A.table(spark, sf, "orders")
    runs = o.select(F.col("o_custkey").alias("run_id")).distinct()
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    an = o.groupBy(
        F.col("o_custkey").alias("run_id"), F.concat(F.lit("a"), (F.col("o_orderkey") % 5).cast("string")).alias("analysis_id")
    ).agg(F.max(F.concat(day, F.lit(" "), F.col("o_orderkey").cast("string"))).alias("at"))

    def entries(rows, at):
        ok = F.concat(F.lit('{"ok":"'), at, F.lit('"}'))
        return rows.select("run_id", "analysis_id", F.lit("gait").alias("preset"), at.alias("created_at"), F.lit("{}").alias("parameters"), ok.alias("qa_summary"))

    path = WR.shared_folder(spark, "manifests")
    WR.write_manifests(WR.run_manifests(runs, F.lit("start")), path)
    WR.upsert_manifests(path, entries(an.where("analysis_id IN ('a0', 'a1', 'a2')"), F.col("at")))
    WR.upsert_manifests(path, entries(an.where("analysis_id IN ('a2', 'a3') AND run_id % 3 <> 0"), F.concat("at", F.lit("+"))))
    ids = F.col("analyses.analysis_id")
    return spark.read.parquet(path).select(
        "run_id", F.size("analyses").cast("long").alias("analyses"), F.array_join(ids, ",").alias("ids"), "latest_analysis_id",
        "quality_summary", "updated_at", F.try_element_at("analyses", F.lit(-1))["artifacts"]["qa"].alias("qa_file"),
    )


@query("absent_records", "P7", f"""WITH {STATUS} SELECT run_id, frame_index, frame_index + 3 AS video_frame, NULL::VARCHAR AS mesh_file, false AS subject_present, 'subject_absent' AS inference_status, CASE WHEN event_id % 4 = 0 THEN 'subject_absent' ELSE 'lost' END AS identity_status, event_id % 5 <> 1 AS identity_is_lost, (event_id % 9)::INT AS identity_lost_frames, score AS identity_stability_score, score + 1 AS first_corner, 0::INT AS identity_reacquire_candidates FROM status WHERE NOT present""")
def absent_records_query(spark, sf):
    e = F.col("event_id")
    s = A.status(spark, sf).where(~F.col("present")).select(
        "run_id", "frame_index", (F.col("frame_index") + 3).alias("video_frame"), F.array("score", "score").alias("raw"),
        F.when(e % 4 != 0, "lost").alias("identity_status"), (e % 5 != 1).alias("identity_is_lost"),
        (e % 9).alias("identity_lost_frames"), F.col("score").alias("identity_stability_score"),
    )
    s = s.withColumn("bbox", F.transform("raw", lambda v: v + 1))
    return absent_records(s, "subject_absent").select(
        "run_id", "frame_index", "video_frame", "mesh_file", "subject_present", "inference_status", "identity_status",
        "identity_is_lost", "identity_lost_frames", "identity_stability_score", F.get("bbox", F.lit(0)).alias("first_corner"),
        "identity_reacquire_candidates",
    )


@query("run_manifest", "S12", """SELECT o_orderkey AS run_id, 'motion.run.v1' AS version, 'v' || o_orderkey || '.mp4' AS video, 4::INT AS frames, 0::INT AS analyses FROM orders WHERE o_orderkey % 10 <> 9""")
def run_manifest(spark, sf):
    runs, _ = RD.parse_runs(_run_docs(spark, sf))
    m = F.from_json("manifest", "struct<schema_version string, source_video string, processed_frames int, analyses array<string>>")
    return WR.build_run_manifest(runs).select("run_id", m.alias("m")).select(
        "run_id", F.col("m.schema_version").alias("version"), F.col("m.source_video").alias("video"),
        F.col("m.processed_frames").alias("frames"), F.size("m.analyses").alias("analyses"),
    )


@query("list_runs", "S13,O2", """SELECT o_custkey AS run_id, max(strftime(o_orderdate, '%Y-%m-%d')) AS updated_at, 'body' AS inference_target FROM orders GROUP BY o_custkey""")
def list_runs(spark, sf):
    m = A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
        F.col("o_orderkey").alias("frame_count"), F.lit("body").alias("inference_target"),
    )
    return RD.list_runs(m).select("run_id", "updated_at", "inference_target")


@query("select_analysis", "S17", """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'b' || o_orderkey END AS analysis_id FROM orders""")
def select_analysis(spark, sf):
    k = F.col("o_orderkey")
    tag = lambda p: F.concat(F.lit(p), k.cast("string"))
    entries = F.array(F.struct(tag("a").alias("analysis_id")), F.struct(tag("b").alias("analysis_id")))
    m = A.table(spark, sf, "orders").select(
        k.alias("run_id"), F.when(k % 3 == 0, tag("p")).alias("latest_analysis_id"),
        F.when(k % 3 == 2, F.slice(entries, 1, 0)).otherwise(entries).alias("analyses"),
    )
    return RD.select_analysis(m)


@query("detection_lines_written", "S14", f"""WITH {BOXES} SELECT video_id, frame, count(*) FILTER (det_id % 4 <> 3)::INT AS dets, {r('frame / 25.0', 3)}::DOUBLE AS t, min(det_id) FILTER (det_id % 4 <> 3) AS first_id FROM boxes GROUP BY ALL""")
def detection_lines_written(spark, sf):
    from stridegrid.functions.boxes import Box, norm_xywh

    b = A.boxes(spark, sf)
    x, y, w, h = norm_xywh(Box.of(), A.WIDTH, A.HEIGHT)
    d = b.select(
        "video_id", "frame", "det_id", F.when(F.col("det_id") % 4 == 3, -1).otherwise(F.col("det_id")).alias("track_id"),
        x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), "score",
    )
    line = F.from_json("line", "struct<f long, t double, dets array<struct<id long, b array<double>, s double>>>")
    return WR.detection_lines(d, 25.0, ["video_id"]).select("video_id", "frame", line.alias("l")).select(
        "video_id", "frame", F.size("l.dets").alias("dets"), tidy(F.col("l.t"), 3).alias("t"), F.get("l.dets", F.lit(0))["id"].alias("first_id")
    )


@query("detection_replay", "S15", f"WITH {BOXES} SELECT video_id, frame, det_id, {r('x1')} AS x1 FROM boxes")
def detection_replay(spark, sf):
    path = WR.shared_folder(spark, "raw")
    WR.raw_detection_dump(A.boxes(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select(F.col("video_id").cast("long").alias("video_id"), "frame", "det_id", tidy(F.col("x1")).alias("x1"))
