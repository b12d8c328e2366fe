"""Queries over aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridegrid.functions import pose as P
from stridegrid.functions.numbers import finite_or_null, norm3, tidy
from stridegrid.operators import aggregates as G
from stridegrid.operators import windows as W
from stridegrid.plans.quantiles import exact_quantiles
from stridegrid.plans.registry import BOXES, POSE, SERIES, STATUS, joint, query, r
from stridegrid.plans.scalar_queries import sql_angle
from stridegrid.sources import adapters as A
from stridegrid.sources.writers import shared_folder

RUN = ["run_id", "frame_index"]
WIN = "PARTITION BY run_id ORDER BY frame_index"

_PV = {a: f"(({joint(9, a)} + {joint(10, a)}) * 0.5)" for a in "xyz"}


@query("knee_and_pelvis_summary", "A3", f"""WITH {POSE}, p AS (SELECT run_id, frame_index, {sql_angle(9, 11, 13)} AS knee, {', '.join(f'CASE WHEN present THEN {v} END AS p{a}' for a, v in _PV.items())} FROM pose),
d AS (SELECT *, sqrt(power(px - lag(px) OVER ({WIN}), 2) + power(py - lag(py) OVER ({WIN}), 2) + power(pz - lag(pz) OVER ({WIN}), 2)) * 30 AS speed FROM p)
SELECT run_id, count(knee) AS frames, {r('avg(knee)')} AS knee_mean_deg, {r('coalesce(stddev_samp(knee), 0)')} AS knee_sd_deg, {r('avg(speed)')} AS pelvis_speed FROM d GROUP BY run_id""")
def knee_and_pelvis_summary(spark, sf):
    df = P.with_points(A.pose(spark, sf), (9, 10, 11, 13), present=F.col("subject_present"))
    p = P.point
    pelvis = P.midpoint(p(9), p(10))
    df = df.select(*RUN, P.angle_between(p(9), p(11), p(13)).alias("knee"), *[c.alias(n) for n, c in pelvis.named("pelvis").items()])
    df = W.speed(df, 30.0, speed=("pelvis_x", "pelvis_y", "pelvis_z"))
    return df.groupBy("run_id").agg(
        F.count("knee").alias("frames"),
        tidy(F.avg("knee")).alias("knee_mean_deg"),
        tidy(G.sample_sd(F.col("knee"))).alias("knee_sd_deg"),
        tidy(F.avg("speed")).alias("pelvis_speed"),
    )


@query("series_quantiles", "A1,A2", f"""WITH {SERIES}, o AS (SELECT run_id, value, row_number() OVER (PARTITION BY run_id ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY run_id) AS n FROM series WHERE value IS NOT NULL),
g AS (SELECT run_id, value AS p10 FROM o WHERE k = least(n - 1, floor(n * 0.10)))
SELECT run_id, {r('quantile_cont(value, 0.12)')} AS q12, {r('quantile_cont(value, 0.65)')} AS q65, {r('max(p10)')} AS floor_p10 FROM series JOIN g USING (run_id) GROUP BY run_id""")
def series_quantiles(spark, sf):
    s = A.series(spark, sf)
    q = exact_quantiles(s, ["run_id"], "value", {"q12": 0.12, "q65": 0.65})
    f = exact_quantiles(s, ["run_id"], "value", {"floor_p10": 0.10}, floor_rank=True)
    return q.join(f, "run_id").select("run_id", *[tidy(F.col(c)).alias(c) for c in ("q12", "q65", "floor_p10")])


@query("mean_sd_n", "A3", f"""WITH {SERIES} SELECT run_id, event_id % 40 AS part, {r('avg(value)', 4)} AS mean, {r('CASE WHEN count(value) > 0 THEN coalesce(stddev_samp(value), 0) END', 4)} AS sd, count(value) AS n FROM series GROUP BY ALL""")
def mean_sd_n(spark, sf):
    s = A.series(spark, sf).withColumn("part", F.col("event_id") % 40)
    v = finite_or_null(F.col("value"))
    return s.groupBy("run_id", "part").agg(
        tidy(F.avg(v), 4).alias("mean"), tidy(G.sample_sd(v), 4).alias("sd"), F.count(v).alias("n")
    )


@query("qa_summary", "A4,F23", f"""WITH {POSE}, f AS (SELECT run_id, CASE WHEN vec_id % 5 < 2 AND present THEN 21 WHEN vec_id % 5 = 3 THEN 20 ELSE 0 END AS n, CASE WHEN vec_id % 3 = 0 THEN abs(e[1]) END AS st FROM pose),
a AS (SELECT run_id, avg((n > 0)::INT) AS jv, avg((n > 20)::INT) AS cv, avg(st) AS ts FROM f GROUP BY run_id)
SELECT run_id, {r('jv')} AS joint_visibility_ratio, {r('cv')} AS critical_joint_visibility_ratio, {r('ts')} AS tracking_score,
 CASE WHEN cv < 0.25 THEN 'non_interpretable' WHEN jv < 0.60 THEN 'needs_review' ELSE 'interpretable' END AS status,
 CASE WHEN cv < 0.25 THEN 'critical_joints_missing' WHEN jv < 0.60 THEN 'low_joint_visibility' END AS reason, {r('least(greatest(run_id * 2.5 / 15, 0), 1)')} AS severity FROM a""")
def qa_summary(spark, sf):
    v = F.col("vec_id") % 5
    df = A.pose(spark, sf).select(
        "run_id",
        F.when((v < 2) & F.col("subject_present"), F.col("joints")).when(v == 3, F.slice("joints", 1, 20)).alias("joints"),
        F.when(F.col("vec_id") % 3 == 0, F.abs(F.get(F.get("joints", F.lit(0)), F.lit(0)))).alias("stability"),
    )
    runs = df.select("run_id").distinct().withColumn("camera_shift_px", F.col("run_id") * 2.5)
    out = G.qa_summary(df, runs)
    return out.select(
        "run_id", *[tidy(F.col(c)).alias(c) for c in ("joint_visibility_ratio", "critical_joint_visibility_ratio", "tracking_score")],
        "status", "reason", tidy(F.col("camera_motion_severity")).alias("severity"),
    )


_ST = """path AS (SELECT run_id, frame_index, coalesce(value, 0) / 100 AS x, (event_id % 17) / 10.0 AS y, coalesce(value, 0) / 90 - 0.1 AS x2, (event_id % 15) / 10.0 AS y2 FROM series),
sc AS (SELECT run_id, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) + sqrt(power(arg_max(x, frame_index) - arg_min(x, frame_index), 2) + power(arg_max(y, frame_index) - arg_min(y, frame_index), 2)) AS s1,
 sqrt(power(max(x2) - min(x2), 2) + power(max(y2) - min(y2), 2)) + sqrt(power(arg_max(x2, frame_index) - arg_min(x2, frame_index), 2) + power(arg_max(y2, frame_index) - arg_min(y2, frame_index), 2)) AS s2 FROM path GROUP BY run_id)"""


def _paths(spark, sf):
    v, e = F.coalesce("value", F.lit(0.0)), F.col("event_id")
    return A.series(spark, sf).select(
        *RUN, (v / 100).alias("x"), ((e % 17) / 10.0).alias("y"), (v / 90 - 0.1).alias("x2"), ((e % 15) / 10.0).alias("y2")
    )


@query("xy_stability", "A5", f"WITH {SERIES}, {_ST} SELECT run_id, {r('s1')} AS score FROM sc")
def xy_stability(spark, sf):
    return G.xy_stability(_paths(spark, sf), "x", "y").withColumn("score", tidy(F.col("score")))


@query("choose_trajectory", "U5", f"WITH {SERIES}, {_ST} SELECT run_id, frame_index, {r('CASE WHEN s1 < s2 THEN x ELSE x2 END')} AS stable_x, {r('(CASE WHEN s1 < s2 THEN y ELSE y2 END)::DOUBLE')} AS stable_y FROM path JOIN sc USING (run_id)")
def choose_trajectory(spark, sf):
    out = G.choose_trajectory(_paths(spark, sf), ("x", "y"), ("x2", "y2"))
    return out.select(*RUN, tidy(F.col("stable_x")).alias("stable_x"), tidy(F.col("stable_y")).alias("stable_y"))


@query("tracklet_color", "A11", """SELECT label::BIGINT AS label, round(quantile_cont(embedding[1]::DOUBLE, 0.5) + 3e-11, 6) AS color_a, round(quantile_cont(embedding[2]::DOUBLE, 0.5) + 3e-11, 6) AS color_b FROM embeddings GROUP BY label""")
def tracklet_color(spark, sf):
    e = A.embeddings(spark, sf).select(
        "label", F.element_at("embedding", 1).cast("double").alias("tab_a"), F.element_at("embedding", 2).cast("double").alias("tab_b")
    )
    return G.tracklet_color(e, ["label"]).select(
        "label", F.round(F.col("color_a") + 3e-11, 6).alias("color_a"), F.round(F.col("color_b") + 3e-11, 6).alias("color_b")
    )


_SUM = """ts AS (SELECT video_id, det_id AS track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frame_count, arg_max(frame, (x2-x1)*(y2-y1) * 1000 - frame) AS rep_frame FROM boxes GROUP BY ALL HAVING count(*) >= 3)"""


def _tracks(spark, sf):
    b = A.boxes(spark, sf).withColumnRenamed("det_id", "track_id")
    return G.track_summary(b, ["video_id", "track_id"], 3)


@query("track_summary", "A12,O2", f"WITH {BOXES}, {_SUM} SELECT * FROM ts")
def track_summary(spark, sf):
    return _tracks(spark, sf)


@query("merge_subjects", "A13", f"""WITH {BOXES}, {_SUM}, m AS (SELECT *, CASE WHEN track_id % 2 = 0 AND track_id < 6 THEN 0 ELSE track_id END AS g FROM ts),
a AS (SELECT video_id, min(track_id) AS subject_id, sum(frame_count)::BIGINT AS frame_count, min(first_frame) AS first_frame, max(last_frame) AS last_frame, arg_max(rep_frame, frame_count * 1000 - track_id) AS rep_frame FROM m GROUP BY video_id, g)
SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_count DESC, subject_id) AS label FROM a""")
def merge_subjects(spark, sf):
    tracks = _tracks(spark, sf)
    merges = tracks.where("track_id % 2 = 0 AND track_id < 6").select("video_id", "track_id", F.lit(0).cast("long").alias("group_id"))
    return G.merge_subjects(tracks, merges, ["video_id"])


_PTS = """pts AS (SELECT run_id, frame_index, e[3*j+1] AS x, e[3*j+2] AS y, e[3*j+3] + 2 AS z FROM (SELECT *, unnest(range(21)) AS j FROM pose))"""


def _points(spark, sf):
    return A.pose(spark, sf).select(*RUN, F.explode("joints").alias("j")).select(
        *RUN, F.col("j")[0].alias("x"), F.col("j")[1].alias("y"), F.col("j")[2].alias("z")
    )


@query("bbox_from_points", "A14", f"""WITH {POSE}, {_PTS}, uv AS (SELECT run_id, frame_index, 1600 * x / z + 640 AS u, 1600 * y / z + 360 AS v FROM pts WHERE z > 1e-6),
q AS (SELECT run_id, frame_index, count(*) AS n, quantile_cont(u, 0.03) AS a, quantile_cont(v, 0.03) AS b, quantile_cont(u, 0.97) AS c, quantile_cont(v, 0.97) AS d FROM uv WHERE u BETWEEN 0 AND 1279 AND v BETWEEN 0 AND 719 GROUP BY ALL),
w AS (SELECT *, least(greatest(a - (c-a)*0.1, 0), 1278) AS x1, least(greatest(b - (d-b)*0.1, 0), 718) AS y1 FROM q),
x AS (SELECT *, least(greatest(c + (c-a)*0.1, x1 + 1), 1279) AS x2, least(greatest(d + (d-b)*0.1, y1 + 1), 719) AS y2 FROM w)
SELECT run_id, frame_index, {', '.join(f"{r(f'CASE WHEN n >= 12 AND NOT (x2 - x1 < 28 AND y2 - y1 < 28) THEN {c} END')} AS {c}" for c in ('x1', 'y1', 'x2', 'y2'))} FROM x""")
def bbox_from_points(spark, sf):
    pts = _points(spark, sf).withColumn("z", F.col("z") + 2)
    out = G.bbox_from_points(pts, RUN, 1600.0, A.WIDTH, A.HEIGHT)
    return out.select(*RUN, *[tidy(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])


_W = lambda j, a: joint(j, a)


def _rot(toe: int, heel: int, sg: str) -> str:
    s = {a: f"({_W(toe, a)} - {_W(heel, a)})" for a in "xyz"}
    al = f"((hx*{s['x']} + hy*{s['y']}) * (1 - cos(sz)))"
    x = f"({s['x']}*cos(sz) + hy*{s['z']}*sin({sg}sz) + hx*{al})"
    y = f"({s['y']}*cos(sz) - hx*{s['z']}*sin({sg}sz) + hy*{al})"
    z = f"({s['z']}*cos(sz) + (hx*{s['y']} - hy*{s['x']})*sin({sg}sz))"
    fl = f"sqrt({x}*{x} + {y}*{y})"
    return f"CASE WHEN {fl} >= 0.05 THEN abs(atan2({z}, {fl})) END"


def _sole(toe: int, heel: int) -> str:
    dx, dy, dz = (f"({_W(toe, a)} - {_W(heel, a)})" for a in "xyz")
    return f"CASE WHEN sqrt({dx}*{dx} + {dy}*{dy}) >= 0.05 THEN atan2({dz}, sqrt({dx}*{dx} + {dy}*{dy})) END"


@query("sole_pitch_bias", "A15", f"""WITH {POSE}, s AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 'left' WHEN vec_id % 3 = 1 THEN 'both' ELSE 'none' END AS support FROM pose WHERE vec_id % 4 <> 0),
f AS (SELECT run_id, frame_index, {_sole(15, 17)} AS p FROM s WHERE support IN ('left', 'both') UNION ALL SELECT run_id, frame_index, {_sole(18, 20)} FROM s WHERE support = 'both'),
o AS (SELECT run_id, p, row_number() OVER (PARTITION BY run_id ORDER BY p) - 1 AS k, count(*) OVER (PARTITION BY run_id) AS n, min(frame_index) OVER (PARTITION BY run_id) AS fi FROM f WHERE p IS NOT NULL),
m AS (SELECT run_id, p AS med, n, fi FROM o WHERE k = least(n - 1, floor(n * 0.5))),
c AS (SELECT q.*, med, n, least(abs(med), 0.3490658503988659) AS sz, ({_W(10, 'x')} - {_W(9, 'x')}) / sqrt(power({_W(10, 'x')} - {_W(9, 'x')}, 2) + power({_W(10, 'y')} - {_W(9, 'y')}, 2)) AS hx,
 ({_W(10, 'y')} - {_W(9, 'y')}) / sqrt(power({_W(10, 'x')} - {_W(9, 'x')}, 2) + power({_W(10, 'y')} - {_W(9, 'y')}, 2)) AS hy FROM pose q JOIN m ON m.run_id = q.run_id AND m.fi = q.frame_index),
z AS (SELECT run_id, {r(f"CASE WHEN n >= 10 AND abs(med) >= 0.02617993877991494 THEN sz * CASE WHEN coalesce({_rot(15, 17, '')}, {_rot(18, 20, '')}, 1e9) <= coalesce({_rot(15, 17, '-')}, {_rot(18, 20, '-')}, 1e9) THEN 1 ELSE -1 END ELSE 0 END")} AS sole_fix FROM c)
SELECT r.run_id, coalesce(sole_fix, 0) AS sole_fix FROM (SELECT DISTINCT run_id FROM pose) r LEFT JOIN z USING (run_id)""")
def sole_pitch_bias(spark, sf):
    v = F.col("vec_id")
    df = A.pose(spark, sf).withColumns(
        {
            "support": F.when(v % 3 == 0, "left").when(v % 3 == 1, "both").otherwise("none"),
            "feet_visible": v % 4 != 0,
        }
    )
    df = P.with_points(df, (9, 10, 15, 17, 18, 20))
    return G.sole_pitch_bias(df).withColumn("sole_fix", tidy(F.col("sole_fix")))


@query("world_anchor", "A16", f"""WITH {POSE}, f AS (SELECT run_id, arg_min(e, frame_index) AS e FROM pose WHERE present GROUP BY run_id), p AS (SELECT run_id, unnest(range(21)) AS j, e FROM f)
SELECT run_id, {r('avg(e[3*j+1])')} AS centre_x, {r('avg(e[3*j+3])')} AS centre_z, {r('quantile_cont(e[3*j+2], 0.97)')} AS floor_y FROM p GROUP BY run_id""")
def world_anchor(spark, sf):
    return G.world_anchor(A.pose(spark, sf)).select("run_id", *[tidy(F.col(c)).alias(c) for c in ("centre_x", "centre_z", "floor_y")])


@query("ground_calibration", "A17", f"""WITH {POSE}, p AS (SELECT run_id, frame_index, -e[3*j+2] AS z FROM (SELECT *, unnest(range(21)) AS j FROM pose)),
q AS (SELECT run_id, frame_index, {', '.join(f'quantile_cont(z, {v / 100}) AS l{i}' for i, v in enumerate(G.GROUND_LEVELS))} FROM p GROUP BY ALL),
d AS (SELECT run_id, {', '.join(f'abs(l{i} - lag(l{i}) OVER ({WIN})) AS d{i}' for i in range(5))} FROM q WHERE frame_index < 10),
j AS (SELECT run_id, count(*) AS n, {', '.join(f'avg(d{i}) AS d{i}' for i in range(5))} FROM d GROUP BY run_id),
c AS (SELECT run_id, CASE {' '.join(f'WHEN d{i} <= least(d0, d1, d2, d3, d4) * 1.35 + 1e-9 THEN {v}' for i, v in enumerate(G.GROUND_LEVELS))} END::DOUBLE AS percentile FROM j WHERE n >= 10)
SELECT q.run_id, q.frame_index, c.percentile, {r("-(CASE WHEN c.percentile IS NOT NULL AND frame_index >= 9 THEN CASE " + ' '.join(f'WHEN percentile = {v} THEN l{i}' for i, v in enumerate(G.GROUND_LEVELS)) + " END ELSE l2 END)")} AS ground_shift FROM q LEFT JOIN c USING (run_id)""")
def ground_calibration(spark, sf):
    pts = _points(spark, sf).select(*RUN, (-F.col("y")).alias("z"))
    return G.ground_calibration(pts, 10).withColumn("ground_shift", tidy(F.col("ground_shift")))


_LOCK = """lk AS (SELECT *, CASE event_id % 6 WHEN 0 THEN 'absent' WHEN 1 THEN 'lost_hold' WHEN 2 THEN 'occluded' ELSE 'tracked' END AS st FROM status)"""


@query("identity_counters", "A18", f"""WITH {STATUS}, {_LOCK}, g AS (SELECT *, st IN ('absent', 'lost_hold') AS gone, coalesce(lag(st) OVER ({WIN}) IN ('absent', 'lost_hold'), false) AS was FROM lk)
SELECT run_id, count(*) FILTER (gone AND NOT was) AS lost_events, count(*) FILTER (gone) AS absent_frames, count(*) FILTER (NOT gone AND was) AS reacquired, count(*) FILTER (st = 'occluded') AS occlusion_holds, count(*) FILTER (gone) AS blocked_switches FROM g GROUP BY run_id""")
def identity_counters(spark, sf):
    e = F.col("event_id") % 6
    df = A.status(spark, sf).withColumn(
        "status", F.when(e == 0, "absent").when(e == 1, "lost_hold").when(e == 2, "occluded").otherwise("tracked")
    )
    return G.identity_counters(df)


@query("timing_summary", "A19", f"""SELECT user_id AS run_id, count(*) AS frames, {r('sum(value)')} AS infer_total, {r('sum(value) / count(*)')} AS infer_per_frame FROM events GROUP BY user_id""")
def timing_summary(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("value").alias("infer"))
    out = G.timing_summary(e, ["infer"], ["run_id"])
    return out.select("run_id", "frames", tidy(F.col("infer_total")).alias("infer_total"), tidy(F.col("infer_per_frame")).alias("infer_per_frame"))


@query("observed_timings", "A19", f"""SELECT count(*) AS frames, {r('sum(value)', 4)} AS infer_total, {r('sum(value) / count(*)')} AS infer_per_frame FROM events""")
def observed_timings(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("value").alias("infer"))
    rows, seen = G.observed_timings(e, ["infer"])
    rows.write.parquet(shared_folder(spark, "records"))
    out = G.timing_row(spark, seen, ["infer"])
    return out.select("frames", tidy(F.col("infer_total"), 4).alias("infer_total"), tidy(F.col("infer_per_frame")).alias("infer_per_frame"))


@query("max_joint_count", "A20", f"WITH {POSE} SELECT run_id, max(CASE WHEN vec_id % 5 = 0 THEN 21 ELSE 10 + vec_id % 7 END)::INT AS joint_count FROM pose GROUP BY run_id")
def max_joint_count(spark, sf):
    v = F.col("vec_id")
    df = A.pose(spark, sf).withColumn("joints", F.when(v % 5 == 0, F.col("joints")).otherwise(F.slice("joints", F.lit(1), (10 + v % 7).cast("int"))))
    return G.max_joint_count(df)


@query("crossing_metrics", "A21", f"""WITH {STATUS}, l AS (SELECT run_id, frame_index, present, CASE WHEN event_id % 4 = 0 THEN 'green' ELSE 'blue' END AS label FROM status),
p AS (SELECT *, last_value(CASE WHEN present THEN label END IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM l)
SELECT run_id, count(*) FILTER (present AND was <> label) AS switches, {r("count(*) FILTER (present AND label = 'blue')::DOUBLE / count(*) FILTER (present)")} AS on_subject, arg_max(present AND label = 'blue', frame_index) AS ended_on_subject, {r('avg(present::INT)')} AS present_ratio FROM p GROUP BY run_id""")
def crossing_metrics(spark, sf):
    df = A.status(spark, sf).withColumns(
        {"label": F.when(F.col("event_id") % 4 == 0, "green").otherwise("blue"), "truth": F.lit("blue")}
    )
    out = G.crossing_metrics(df)
    return out.select("run_id", "switches", tidy(F.col("on_subject")).alias("on_subject"), "ended_on_subject", tidy(F.col("present_ratio")).alias("present_ratio"))


_CH = {"largest": "(x2-x1)*(y2-y1) DESC", "leftmost": "x1", "rightmost": "x2 DESC", "center": "abs((x1+x2)*0.5 - 640)", "tightest": "(x2-x1)*(y2-y1)"}


@query("choose_candidate", "A22", f"WITH {BOXES} " + " UNION ALL ".join(
    f"(SELECT '{s}' AS strategy, video_id, frame, det_id FROM boxes QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY {o}, det_id) = 1)" for s, o in _CH.items()))
def choose_candidate(spark, sf):
    b = A.boxes(spark, sf)
    out = None
    for s in _CH:
        one = G.choose_candidate(b, ["video_id", "frame"], s, A.WIDTH, A.HEIGHT).select(
            F.lit(s).alias("strategy"), "video_id", "frame", "det_id"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("padded_range", "A23", f"""WITH {SERIES}, m AS (SELECT run_id, event_id % 90 AS part, min(value) AS a, max(value) AS b FROM series GROUP BY ALL), g AS (SELECT *, CASE WHEN b - a > 0 THEN (b - a) * 0.08 WHEN abs(a) > 1e-9 THEN abs(a) * 0.1 ELSE 1 END AS w FROM m)
SELECT run_id, part, {r('coalesce(a - w, 0)')} AS low, {r('coalesce(b + w, 1)')} AS high FROM g""")
def padded_range(spark, sf):
    s = A.series(spark, sf).withColumn("part", F.col("event_id") % 90)
    out = G.padded_range(s, ["run_id", "part"], "value")
    return out.select("run_id", "part", tidy(F.col("low")).alias("low"), tidy(F.col("high")).alias("high"))


@query("tracking_confidence", "P16", f"""WITH {BOXES}, k AS (SELECT video_id, frame, score, row_number() OVER (PARTITION BY video_id, frame ORDER BY score DESC) AS n FROM boxes),
t AS (SELECT video_id, frame, max(score) FILTER (n = 1) AS a, max(score) FILTER (n = 2) AS b, count(*) AS c FROM k GROUP BY ALL), m AS (SELECT *, CASE WHEN c >= 2 THEN a - b ELSE greatest(a, 0.08) END AS mg FROM t)
SELECT video_id, frame, {r('CASE WHEN frame % 3 <> 0 THEN least(greatest(mg / 0.16, 0), 1) ELSE 0 END')} AS confidence, (frame % 3 <> 0 AND c >= 2 AND mg < 0.0799) AS ambiguous FROM m""")
def tracking_confidence(spark, sf):
    b = A.boxes(spark, sf).select("video_id", "frame", F.col("score").alias("reward"), (F.col("frame") % 3 != 0).alias("present"))
    out = G.tracking_confidence(b, ["video_id", "frame"], margin=0.0799)
    return out.select("video_id", "frame", tidy(F.col("confidence")).alias("confidence"), "ambiguous")


_SIG = """prim AS (SELECT run_id, 's' || (event_id % 6)::VARCHAR AS signal_id, frame_index, value FROM series WHERE event_id % 2 = 0),
der AS (SELECT run_id, 's' || (event_id % 9)::VARCHAR AS signal_id, frame_index, value * 2 AS value FROM series WHERE event_id % 3 = 0)"""


def _signals(spark, sf):
    s, e = A.series(spark, sf), F.col("event_id")
    name = lambda m: F.concat(F.lit("s"), (e % m).cast("string"))
    return (
        s.where(e % 2 == 0).select("run_id", name(6).alias("signal_id"), "frame_index", "value"),
        s.where(e % 3 == 0).select("run_id", name(9).alias("signal_id"), "frame_index", (F.col("value") * 2).alias("value")),
    )


@query("merge_signals", "U1", f"""WITH {SERIES}, {_SIG} SELECT run_id, signal_id, frame_index, {r('value')} AS value FROM prim UNION ALL SELECT run_id, signal_id, frame_index, {r('value')} FROM der d WHERE NOT EXISTS (SELECT 1 FROM prim p WHERE p.run_id = d.run_id AND p.signal_id = d.signal_id)""")
def merge_signals(spark, sf):
    from stridegrid.operators.signals import merge_signals

    return merge_signals(*_signals(spark, sf)).withColumn("value", tidy(F.col("value")))


@query("override_signals", "U2", f"""WITH {SERIES}, {_SIG} SELECT run_id, signal_id, frame_index, {r('value')} AS value FROM der UNION ALL SELECT run_id, signal_id, frame_index, {r('value')} FROM prim d WHERE NOT EXISTS (SELECT 1 FROM der p WHERE p.run_id = d.run_id AND p.signal_id = d.signal_id)""")
def override_signals(spark, sf):
    from stridegrid.operators.signals import override_signals

    return override_signals(*_signals(spark, sf)).withColumn("value", tidy(F.col("value")))


@query("union_dedupe", "U3", """WITH u AS (SELECT doc_id AS id, 0 AS src, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark)
SELECT id, src, length(text) AS size FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY src) = 1""")
def union_dedupe(spark, sf):
    from stridegrid.operators.signals import union_dedupe

    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("size"))
    b = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("size"))
    return union_dedupe([d, b], "id").select("id", "src", F.col("size").cast("long").alias("size"))


@query("normalize_signal", "U4", f"""WITH {SERIES}, n AS (SELECT run_id, count(*) AS n FROM series GROUP BY run_id), sp AS (SELECT run_id, unnest(range(0, n + 5)) AS frame_index FROM n),
sg AS (SELECT run_id, 'v' AS signal_id, frame_index, value FROM series WHERE event_id % 2 = 0)
SELECT sp.run_id, 'v' AS signal_id, sp.frame_index, {r('sg.value')} AS value FROM sp LEFT JOIN sg USING (run_id, frame_index) WHERE run_id IN (SELECT run_id FROM sg)""")
def normalize_signal(spark, sf):
    from stridegrid.operators.signals import normalize_signals

    s = A.series(spark, sf)
    n = s.groupBy("run_id").agg((F.count(F.lit(1)) + 5).alias("n"))
    spine = n.select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame_index"))
    sig = s.where("event_id % 2 = 0").select("run_id", F.lit("v").alias("signal_id"), "frame_index", "value")
    return normalize_signals(sig, spine).withColumn("value", tidy(F.col("value")))


@query("ordered_events", "O1", f"""WITH {STATUS}, ev AS (SELECT run_id, frame_index, CASE WHEN "left" THEN 'left' ELSE 'right' END AS side, CASE WHEN ambiguous THEN 'toe_off' ELSE 'heel_strike' END AS type FROM status WHERE present)
SELECT run_id, frame_index, side, type, row_number() OVER (PARTITION BY run_id ORDER BY frame_index, side, type) AS nth FROM ev""")
def ordered_events(spark, sf):
    from stridegrid.operators.signals import order_events

    ev = A.status(spark, sf).where("present").select(
        *RUN, F.when(F.col("left"), "left").otherwise("right").alias("side"),
        F.when(F.col("ambiguous"), "toe_off").otherwise("heel_strike").alias("type"),
    )
    return order_events(ev)
