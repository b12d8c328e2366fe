"""Queries over joins of boxes, vectors, runs and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridegrid.functions.numbers import tidy
from stridegrid.functions.boxes import Box
from stridegrid.operators import joins as J
from stridegrid.operators import windows as W
from stridegrid.operators.frames import frame_record_join, normalize_frames
from stridegrid.plans.blocks import Line
from stridegrid.plans.registry import BOXES, SERIES, SPANS, STATUS, query, r
from stridegrid.sources import adapters as A

RUN = ["run_id", "frame_index"]
WIN = "PARTITION BY run_id ORDER BY frame_index"

_I = ("(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * "
      "greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))")
_IOU = f"({_I} / ((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - {_I}))"
_PAIRS = f"""pairs AS (SELECT a.video_id, a.frame, a.det_id AS a_det_id, b.det_id AS b_det_id, {_IOU} AS iou
 FROM boxes a JOIN boxes b ON a.video_id = b.video_id AND a.frame = b.frame AND a.det_id < b.det_id)"""


@query("frame_record_join", "J1,P5", f"""WITH {STATUS}
SELECT s.run_id, s.frame_index, s.inference_status, NOT coalesce(s.inference_status IN ('masked','subject_absent'), false) AND NOT coalesce(q.lost, false) AS present,
 {r("CASE WHEN NOT coalesce(s.inference_status IN ('masked','subject_absent'), false) AND NOT coalesce(q.lost, false) THEN q.score END")} AS tracking_score
FROM status s LEFT JOIN (SELECT run_id, frame_index, event_id % 11 = 0 AS lost, score FROM status WHERE event_id % 3 <> 0) q USING (run_id, frame_index)""")
def frame_record_join_query(spark, sf):
    s = A.status(spark, sf)
    frames = s.select(*RUN, "inference_status")
    records = s.where("event_id % 3 <> 0").select(
        *RUN,
        (F.col("event_id") % 11 == 0).alias("identity_is_lost"),
        F.col("score").alias("identity_gallery_similarity"),
    )
    out = normalize_frames(frame_record_join(frames, records))
    return out.select(*RUN, "inference_status", "present", tidy(F.col("tracking_score")).alias("tracking_score"))


@query("pairwise_overlap", "J2", f"""WITH {BOXES}, {_PAIRS}
SELECT video_id, frame, a_det_id, b_det_id, {r('iou')} AS iou FROM pairs WHERE iou >= 0.30""")
def pairwise_overlap(spark, sf):
    return J.pairwise_overlap(A.boxes(spark, sf)).withColumn("iou", tidy(F.col("iou")))


@query("isolated_detections", "J2", f"""WITH {BOXES}, {_PAIRS}
SELECT video_id, frame, det_id FROM boxes o WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.video_id = o.video_id AND p.frame = o.frame AND p.iou >= 0.30 AND o.det_id IN (p.a_det_id, p.b_det_id))""")
def isolated_detections(spark, sf):
    return J.isolated(A.boxes(spark, sf)).select("video_id", "frame", "det_id")


@query("crossing_iou", "J2", f"""WITH {BOXES}, {_PAIRS}, m AS (SELECT video_id, frame, max(iou) AS m FROM pairs GROUP BY ALL)
SELECT video_id, frame, {r('coalesce(m, 0)')} AS crossing_iou FROM (SELECT DISTINCT video_id, frame FROM boxes) LEFT JOIN m USING (video_id, frame)""")
def crossing_iou(spark, sf):
    return J.crossing_iou(A.boxes(spark, sf)).withColumn("crossing_iou", tidy(F.col("crossing_iou")))


@query("strip_clear", "J3", f"""WITH {BOXES}, st AS (SELECT *, x1 + 0.30*(x2-x1) AS a1, y1 + 0.55*(y2-y1) AS b1, x2 - 0.30*(x2-x1) AS a2, y1 + 0.92*(y2-y1) AS b2 FROM boxes)
SELECT s.video_id, s.frame, s.det_id FROM st s WHERE NOT EXISTS (SELECT 1 FROM boxes o WHERE o.video_id = s.video_id AND o.frame = s.frame AND o.det_id <> s.det_id
 AND greatest(0, least(a2, o.x2) - greatest(a1, o.x1)) * greatest(0, least(b2, o.y2) - greatest(b1, o.y1)) / ((a2-a1)*(b2-b1)) > 0.15)""")
def strip_clear(spark, sf):
    return J.strip_clear(A.boxes(spark, sf)).select("video_id", "frame", "det_id")


_NEXT = "(SELECT video_id, frame + 1 AS frame, det_id, x1 + 4 AS x1, y1, x2 + 4 AS x2, y2 FROM boxes)"


@query("iou_candidates", "J4", f"""WITH {BOXES}, p AS (SELECT a.video_id, a.frame, a.det_id AS track, b.det_id AS det_id, {_IOU} AS iou, b.score, b.score > 0.95 AS alone
 FROM {_NEXT} a JOIN boxes b ON a.video_id = b.video_id AND a.frame = b.frame)
SELECT video_id, frame, track, det_id, {r('-(iou + CASE WHEN alone THEN 0.35 * score ELSE 0 END)')} AS cost FROM p WHERE iou >= 0.10""")
def iou_candidates(spark, sf):
    return _costs(spark, sf).select("video_id", "frame", "track", "det_id", tidy(F.col("cost")).alias("cost"))


def _costs(spark, sf):
    b = A.boxes(spark, sf)
    moved = b.withColumns({"frame": F.col("frame") + 1, "x1": F.col("x1") + 4, "x2": F.col("x2") + 4}).drop("score")
    dets = b.withColumns({"sim": F.col("score"), "isolated": F.col("score") > 0.95}).drop("score")
    return J.iou_candidates(moved, dets).select(
        "video_id", "frame", F.col("a_det_id").alias("track"), F.col("b_det_id").alias("det_id"), "cost"
    )


@query("similarity_join", "J5", f"""WITH g AS (SELECT label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM g),
s AS (SELECT e.vec_id, u.label, list_cosine_similarity(u.v, e.embedding::DOUBLE[]) AS sim FROM embeddings e, u),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY sim DESC) AS rk FROM s),
m AS (SELECT vec_id, label, avg(sim) AS sim FROM k WHERE rk <= 5 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rk, lead(sim) OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS second FROM m)
SELECT vec_id, label::BIGINT AS track_id, {r('sim')} AS similarity, {r('sim - second')} AS margin,
 CASE WHEN sim >= 0.84 THEN 'strict' WHEN sim >= 0.76 AND sim - second >= 0.03 THEN 'recent' WHEN sim >= 0.60 AND sim - second >= 0.03 THEN 'floor' END AS level FROM o WHERE rk = 1""")
def similarity_join(spark, sf):
    e = A.embeddings(spark, sf)
    g = J.label_galleries(e, 64).withColumnRenamed("label", "track_id")
    out = J.similarity_join(e, g, tiles=2, parts=8)
    return out.select(
        "vec_id", "track_id", tidy(F.col("similarity")).alias("similarity"),
        tidy(F.col("margin")).alias("margin"),
        J.match_level(F.col("similarity"), F.col("margin")).alias("level"),
    )


@query("assign_one_to_one", "J6")
def assign_one_to_one(spark, sf):
    return J.assign_one_to_one(_costs(spark, sf), ["video_id", "frame"], "track", "det_id").withColumn(
        "cost", tidy(F.col("cost"))
    )


@query("nms", "J18", f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY score DESC, det_id) AS k FROM boxes),
cf AS (SELECT a.video_id, a.frame, a.k AS ka, b.k AS kb FROM o a JOIN o b ON a.video_id = b.video_id AND a.frame = b.frame AND a.k < b.k WHERE {_IOU} >= 0.55),
ag AS (SELECT video_id, frame, kb AS k, list(ka) AS rivals FROM cf GROUP BY ALL),
oo AS (SELECT o.*, coalesce(rivals, []) AS rivals FROM o LEFT JOIN ag USING (video_id, frame, k)),
rec AS (SELECT video_id, frame, 1 AS k, [1::BIGINT] AS kept FROM oo WHERE k = 1
 UNION ALL SELECT n.video_id, n.frame, n.k, CASE WHEN list_has_any(rec.kept, n.rivals) THEN rec.kept ELSE list_append(rec.kept, n.k) END
 FROM rec JOIN oo n ON n.video_id = rec.video_id AND n.frame = rec.frame AND n.k = rec.k + 1),
fin AS (SELECT video_id, frame, arg_max(kept, k) AS kept FROM rec GROUP BY ALL)
SELECT o.video_id, o.frame, o.det_id, {r('o.score')} AS score FROM o JOIN fin f ON f.video_id = o.video_id AND f.frame = o.frame WHERE list_contains(f.kept, o.k)""")
def nms(spark, sf):
    return J.nms(A.boxes(spark, sf)).select("video_id", "frame", "det_id", tidy(F.col("score")).alias("score"))


@query("asof_hold", "J11", f"""WITH {SERIES}, rec AS (SELECT run_id, frame_index, CASE WHEN value IS NOT NULL THEN value / 10 END AS b FROM series WHERE event_id % 3 = 0)
SELECT s.run_id, s.frame_index, {r('(SELECT arg_max_null(rec.b, rec.frame_index) FROM rec WHERE rec.run_id = s.run_id AND rec.frame_index <= s.frame_index)')} AS held FROM series s""")
def asof_hold(spark, sf):
    s = A.series(spark, sf)
    rec = s.where("event_id % 3 = 0").select(
        "run_id", F.col("frame_index").alias("video_frame"),
        F.when(F.col("value").isNotNull(), F.array(F.col("value") / 10)).alias("bbox"),
    )
    out = J.asof_hold(s.select(*RUN), rec)
    return out.select(*RUN, tidy(F.get("bbox", F.lit(0))).alias("held"))


@query("asof_nearest", "J12", f"""WITH {SERIES}, fr AS (SELECT run_id, frame_index, frame_index * 3 + (event_id % 2) AS vf FROM series),
t AS (SELECT run_id, event_id, coalesce(value, 0) * 1.7 AS target FROM series),
b AS (SELECT t.run_id, t.event_id, t.target, (SELECT max(struct_pack(v := vf, i := frame_index)) FROM fr WHERE fr.run_id = t.run_id AND vf < target) AS p,
 (SELECT min(struct_pack(v := vf, i := frame_index)) FROM fr WHERE fr.run_id = t.run_id AND vf >= target) AS n FROM t)
SELECT run_id, event_id, CASE WHEN n IS NULL THEN p.i WHEN p IS NULL THEN n.i WHEN abs(p.v - target) <= abs(n.v - target) THEN p.i ELSE n.i END AS nearest,
 {r('CASE WHEN p IS NULL THEN 0 WHEN n IS NULL THEN p.i ELSE p.i + least(greatest((target - p.v) / greatest(1e-6, n.v - p.v), 0), 1) END')} AS cursor FROM b""")
def asof_nearest(spark, sf):
    s = A.series(spark, sf)
    frames = s.select("run_id", "frame_index", (F.col("frame_index") * 3 + F.col("event_id") % 2).alias("video_frame"))
    times = s.select("run_id", "event_id", (F.coalesce("value", F.lit(0.0)) * 1.7).alias("target"))
    out = J.asof_nearest(times, frames)
    return out.select("run_id", "event_id", "nearest", tidy(F.col("cursor")).alias("cursor"))


_RES = """res AS (SELECT run_id, frame_index, CASE WHEN event_id % 2 = 0 THEN 'absent' ELSE 'present' END AS state, (event_id % 10) / 10.0 AS confidence, event_id % 5 = 0 AS ambiguous FROM status WHERE event_id % 4 = 0 OR event_id % 4 = 1)"""


@query("carry_resolution", "J13,G9", f"""WITH {STATUS}, {_RES}, j AS (SELECT s.run_id, s.frame_index, s.present, s.score, x.state, x.confidence::DOUBLE AS confidence, x.ambiguous FROM status s LEFT JOIN res x USING (run_id, frame_index)),
h AS (SELECT run_id, frame_index, present, score, last_value(state IGNORE NULLS) OVER ({WIN}) AS st, last_value(confidence IGNORE NULLS) OVER ({WIN}) AS cf, last_value(ambiguous IGNORE NULLS) OVER ({WIN}) AS am FROM j),
k AS (SELECT *, present AND coalesce(st, 'u') = 'absent' AND (score IS NULL OR score < 20) AS suppressed FROM h)
SELECT run_id, frame_index, suppressed, present AND NOT suppressed AS subject_present, {r('CASE WHEN present THEN cf END')} AS identity_confidence, present AND coalesce(am, false) AS identity_ambiguous,
 CASE WHEN suppressed THEN 'distractor_suppressed' WHEN present THEN 'tracked' ELSE 'subject_lost' END AS tracking_status FROM k""")
def carry_resolution(spark, sf):
    s = A.status(spark, sf)
    e = F.col("event_id")
    res = s.where((e % 4 == 0) | (e % 4 == 1)).select(
        *RUN, F.when(e % 2 == 0, "absent").otherwise("present").alias("state"),
        ((e % 10) / 10.0).alias("confidence"), (e % 5 == 0).alias("ambiguous"),
    )
    out = J.carry_resolution(s.select(*RUN, "present", F.col("score").alias("gallery")), res, 20.0)
    return out.select(
        *RUN, "suppressed", "subject_present", tidy(F.col("identity_confidence")).alias("identity_confidence"),
        "identity_ambiguous", "tracking_status",
    )


@query("subject_selection", "J14", f"""WITH {BOXES}, d AS (SELECT *, det_id AS track_id FROM boxes), s AS (SELECT *, CASE WHEN track_id IN (0, 2) THEN 0 ELSE 1 END AS subject_id FROM d WHERE track_id <= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, video_id, frame ORDER BY score DESC, det_id) AS n FROM s)
SELECT subject_id, video_id, frame, floor(x1 + 0.5)::BIGINT AS x1, floor(y2 + 0.5)::BIGINT AS y2, {r('score')} AS score FROM k WHERE n = 1""")
def subject_selection(spark, sf):
    subjects = spark.createDataFrame([(0, [0, 2]), (1, [1, 3])], "subject_id int, track_ids array<long>")
    dets = A.boxes(spark, sf).withColumn("track_id", F.col("det_id"))
    out = J.select_subject_tracks(dets, subjects, A.WIDTH, A.HEIGHT)
    return out.select("subject_id", "video_id", "frame", "x1", "y2", tidy(F.col("score")).alias("score"))


_RUNS = """runs AS (SELECT o_orderkey AS run_id, 'track-' || (o_custkey % 7000)::VARCHAR || '-' || o_orderpriority AS track_file FROM orders)"""


def _runs(spark, sf):
    return A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("track-"), (F.col("o_custkey") % 7000).cast("string"), F.lit("-"), F.col("o_orderpriority")).alias("track_file"),
    )


@query("sibling_runs", "J15", f"""WITH {_RUNS}, p AS (SELECT min(run_id) AS run_id, track_file FROM runs GROUP BY track_file) SELECT p.run_id, b.run_id AS sibling_id, track_file FROM p JOIN runs b USING (track_file) WHERE p.run_id <> b.run_id""")
def sibling_runs(spark, sf):
    runs = _runs(spark, sf)
    primaries = runs.groupBy("track_file").agg(F.min("run_id").alias("run_id"))
    return J.sibling_runs(runs, primaries)


@query("finished_runs", "J21", f"""WITH {_RUNS} SELECT run_id, track_file FROM runs WHERE run_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')""")
def finished_runs(spark, sf):
    active = A.table(spark, sf, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("run_id"))
    return J.finished_runs(_runs(spark, sf), active)


@query("aligned_siblings", "J22", f"""WITH {SERIES}, n AS (SELECT run_id, max(frame_index) + 1 AS n FROM series GROUP BY run_id),
p AS (SELECT a.run_id, b.run_id AS sibling_id, b.n FROM n a JOIN n b ON b.run_id = a.run_id + 1)
SELECT s.run_id, s.frame_index, p.sibling_id, least(s.frame_index, p.n - 1) AS sibling_frame FROM series s JOIN p USING (run_id)""")
def aligned_siblings(spark, sf):
    frames = A.series(spark, sf).select(*RUN)
    ids = frames.select("run_id").distinct()
    pairs = ids.join(ids.select((F.col("run_id") - 1).alias("run_id"), F.col("run_id").alias("sibling_id")), "run_id")
    return J.align_siblings(frames, pairs)


@query("toe_off_in_stride", "J16,W8", f"""WITH {STATUS}, onoff AS (SELECT *, ("left" AND present) AS on_now FROM status), e AS (SELECT *, lag(on_now) OVER ({WIN}) AS was FROM onoff),
ev AS (SELECT run_id, frame_index, CASE WHEN on_now THEN 'heel_strike' ELSE 'toe_off' END AS type FROM e WHERE on_now <> was),
st AS (SELECT run_id, frame_index AS start_frame, lead(frame_index) OVER ({WIN}) AS end_frame FROM ev WHERE type = 'heel_strike')
SELECT s.run_id, 'left' AS side, start_frame, end_frame, {r('(end_frame - start_frame) / 30.0')}::DOUBLE AS duration_s, min(o.frame_index) AS toe_off
FROM st s LEFT JOIN ev o ON o.run_id = s.run_id AND o.type = 'toe_off' AND o.frame_index > start_frame AND o.frame_index < end_frame WHERE end_frame IS NOT NULL GROUP BY ALL""")
def toe_off_in_stride(spark, sf):
    from stridegrid.operators.events import strides

    ev = W.contact_edges(A.status(spark, sf), "left", "present").withColumn("side", F.lit("left"))
    out = J.toe_off_in_stride(strides(ev, 30.0), ev)
    return out.withColumn("duration_s", tidy(F.col("duration_s")))


@query("nearest_present", "J19", f"""WITH {STATUS}, b AS (SELECT *, last_value(CASE WHEN ambiguous THEN frame_index END IGNORE NULLS) OVER ({WIN} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS b,
 first_value(CASE WHEN ambiguous THEN frame_index END IGNORE NULLS) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS a FROM status)
SELECT run_id, frame_index, CASE WHEN present THEN CASE WHEN a IS NULL OR frame_index - b <= a - frame_index THEN b ELSE coalesce(a, b) END END AS nearest FROM b""")
def nearest_present(spark, sf):
    return J.nearest_present(A.status(spark, sf), "ambiguous").select(*RUN, "nearest")


@query("primary_anchor", "J20", f"""WITH {SERIES}, a AS (SELECT *, row_number() OVER ({WIN}) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM series WHERE event_id % 5 < 2)
SELECT run_id, frame_index, event_id FROM a WHERE k = n // 2 + 1""")
def primary_anchor(spark, sf):
    anchors = A.series(spark, sf).where("event_id % 5 < 2")
    return J.primary_anchor(anchors, ["run_id"]).select(*RUN, "event_id")


_HITS = """hits AS (SELECT doc_id AS frame_id, v.variant, doc_id * 10 + v.k AS det_id FROM documents, (VALUES ('person', 0, 2), ('person in blue', 1, 3), ('person in blue with bag', 2, 7), ('dog', 3, 5)) v(variant, k, m) WHERE (doc_id + v.k) % v.m = 0)"""


@query("fallback_match", "J17", f"""WITH {_HITS}, gated AS (SELECT * FROM hits WHERE frame_id IN (SELECT frame_id FROM hits WHERE variant = 'person')),
rk AS (SELECT * FROM (VALUES ('person in blue with bag', 'person in blue with bag', 0), ('person in blue with bag', 'person in blue', 1), ('dog', 'dog', 0)) t(prompt, variant, rnk)),
tried AS (SELECT g.*, rk.prompt, rk.rnk FROM gated g JOIN rk USING (variant)),
best AS (SELECT frame_id, prompt, min(rnk) AS rnk FROM tried GROUP BY ALL),
sp AS (SELECT frame_id, det_id, CASE WHEN variant = prompt THEN 'prompt:' ELSE 'prompt_fallback:' END || variant AS source FROM tried JOIN best USING (frame_id, prompt, rnk))
SELECT * FROM sp UNION ALL SELECT frame_id, det_id, 'prompt_fallback:person' FROM hits WHERE variant = 'person' AND frame_id NOT IN (SELECT frame_id FROM sp)""")
def fallback_match(spark, sf):
    from stridegrid.functions.text import simplify_chain

    kinds = F.array(
        *[F.struct(F.lit(v).alias("variant"), F.lit(k).alias("k"), F.lit(m).alias("m"))
          for v, k, m in (("person", 0, 2), ("person in blue", 1, 3), ("person in blue with bag", 2, 7), ("dog", 3, 5))]
    )
    d = A.table(spark, sf, "documents").select("doc_id", F.explode(kinds).alias("v"))
    hits = d.where((F.col("doc_id") + F.col("v.k")) % F.col("v.m") == 0).select(
        F.col("doc_id").alias("frame_id"), "v.variant", (F.col("doc_id") * 10 + F.col("v.k")).alias("det_id")
    )
    prompts = spark.createDataFrame([("person in blue with bag",), ("dog",)], "prompt string")
    prompts = prompts.withColumn("variants", simplify_chain(F.col("prompt")))
    return J.fallback_match(hits, prompts)
