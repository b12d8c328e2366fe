"""Queries over box, vector and pose functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridegrid.functions import boxes as B
from stridegrid.functions import numbers as N
from stridegrid.functions import pose as P
from stridegrid.functions import vectors as V
from stridegrid.functions.numbers import tidy
from stridegrid.plans.blocks import RUNS, Line, neighbourhood
from stridegrid.plans.registry import BOXES, POSE, SERIES, STATUS, joint, query, r
from stridegrid.sources import adapters as A

W, H = A.WIDTH, A.HEIGHT
KEY = ["video_id", "frame", "det_id"]
KEYS = "video_id, frame, det_id"
RUN = ["run_id", "frame_index"]


def _other() -> B.Box:
    b = B.Box.of()
    return B.Box(b.x1 + 17, b.y1 - 9, b.x2 + 11 * F.col("score"), b.y2 + 5)


_PAIR = BOXES + """, pair AS (
  SELECT *, x1 + 17 AS ox1, y1 - 9 AS oy1, x2 + 11 * score AS ox2, y2 + 5 AS oy2 FROM boxes)"""
_INTER = ("greatest(0, least(x2, ox2) - greatest(x1, ox1)) * "
          "greatest(0, least(y2, oy2) - greatest(y1, oy1))")
_UNION = f"((x2 - x1) * (y2 - y1) + (ox2 - ox1) * (oy2 - oy1) - {_INTER})"
_DIAG = "sqrt(power(greatest(1, x2 - x1), 2) + power(greatest(1, y2 - y1), 2))"
_MOVE = "sqrt(power((ox1 + ox2) / 2 - (x1 + x2) / 2, 2) + power((oy1 + oy2) / 2 - (y1 + y2) / 2, 2))"


@query("box_iou", "F1", f"""WITH {_PAIR}
SELECT {KEYS}, {r(f'{_INTER} / {_UNION}')} AS iou, {r(f'{_INTER} / {_UNION}')} AS iou_floored
FROM pair""")
def box_iou(spark, sf):
    b, o = B.Box.of(), _other()
    return A.boxes(spark, sf).select(
        *KEY, tidy(B.iou(b, o)).alias("iou"), tidy(B.iou_floored(b, o)).alias("iou_floored")
    )


@query("box_shapes", "F2", f"""WITH {BOXES}, c AS (
  SELECT *, least(greatest(x1, 0), {W - 2}) AS cx1, least(greatest(y1, 0), {H - 2}) AS cy1
  FROM boxes)
SELECT {KEYS}, {r('(x1 + x2) * 0.5')} AS cx, {r('(y1 + y2) * 0.5')} AS cy,
  {r('greatest(1, x2 - x1) * greatest(1, y2 - y1)')} AS area,
  {r('cx1')} AS clip_x1, {r(f'least(greatest(x2, cx1 + 1), {W - 1})')} AS clip_x2,
  {r(f'least(greatest(y2, cy1 + 1), {H - 1})')} AS clip_y2,
  {r(f'least(greatest(x2, 0), {W})')} AS det_x2, {r(f'least(greatest(y1, 0), {H - 1})')} AS det_y1,
  {r('x1 * 0.5')} AS half_x1,
  {r(f'least(greatest((x1 + x2) * 0.5 - (x2 - x1) * 1.12 / 2, 0), {W - 2})')} AS wide_x1,
  {r('x1 * (1 - score) + (x1 + 30) * score')} AS lerp_x1,
  {r('0.7 * (x1 + 30) + 0.3 * x1')} AS blend_x1
FROM c""")
def box_shapes(spark, sf):
    b = B.Box.of()
    newer = B.Box(b.x1 + 30, b.y1, b.x2 + 30, b.y2)
    c, d = b.clip_inside(W, H), b.clip_detector(W, H)
    return A.boxes(spark, sf).select(
        *KEY,
        tidy(b.cx).alias("cx"),
        tidy(b.cy).alias("cy"),
        tidy(b.area).alias("area"),
        tidy(c.x1).alias("clip_x1"),
        tidy(c.x2).alias("clip_x2"),
        tidy(c.y2).alias("clip_y2"),
        tidy(d.x2).alias("det_x2"),
        tidy(d.y1).alias("det_y1"),
        tidy(b.scale(0.5).x1).alias("half_x1"),
        tidy(b.expand(1.12, 1.12, W, H).x1).alias("wide_x1"),
        tidy(b.lerp(newer, F.col("score")).x1).alias("lerp_x1"),
        tidy(b.blend(newer, 0.7).x1).alias("blend_x1"),
    )


@query("box_conversions", "F3", f"""WITH {BOXES}
SELECT {KEYS}, {r('(x1 + x2) * 0.5')} AS cx, {r('x2 - x1')} AS w,
  round_even(x1 / 1279, 5) AS nx, round_even((y2 - y1) / 719, 5) AS nh,
  floor(x1 / 1279 * 1279 + 0.5)::BIGINT AS px,
  floor((y1 / 719 + (y2 - y1) / 719) * 719 + 0.5)::BIGINT AS py2,
  {r(f'least(greatest((x2 - x1) / 1279, 0), 1)')} AS payload_w,
  {r(f'least(greatest(y1 / 719, 0), 1)')} AS payload_y
FROM boxes""")
def box_conversions(spark, sf):
    b = B.Box.of()
    nx, ny, nw, nh = b.x1 / 1279.0, b.y1 / 719.0, (b.x2 - b.x1) / 1279.0, (b.y2 - b.y1) / 719.0
    px = B.denorm_xyxy(nx, ny, nw, nh, 1279.0, 719.0)
    return A.boxes(spark, sf).select(
        *KEY,
        tidy(b.cx).alias("cx"),
        tidy(b.x2 - b.x1).alias("w"),
        B.norm_xywh(b, 1279.0, 719.0)[0].alias("nx"),
        B.norm_xywh(b, 1279.0, 719.0)[3].alias("nh"),
        px[0].alias("px"),
        px[3].alias("py2"),
        tidy(B.box_payload(b, 1279.0, 719.0)[2]).alias("payload_w"),
        tidy(B.box_payload(b, 1279.0, 719.0)[1]).alias("payload_y"),
    )


@query("box_motion", "F4,F5", f"""WITH {_PAIR}
SELECT {KEYS},
  {r('x1 + (score * 4) * 3')} AS pred_x1, {r('y2 - 2 * 3.0')} AS pred_y2,
  {r(f'0.55 + 0.40 * least(greatest({_MOVE} / sqrt(power(greatest(1, ox2 - ox1), 2) + power(greatest(1, oy2 - oy1), 2)) / 0.10, 0), 1)')} AS alpha
FROM pair""")
def box_motion(spark, sf):
    b, o = B.Box.of(), _other()
    p = b.shift(F.col("score") * 4, F.lit(-2.0), 3)
    return A.boxes(spark, sf).select(
        *KEY,
        tidy(p.x1).alias("pred_x1"),
        tidy(p.y2).alias("pred_y2"),
        tidy(B.adaptive_alpha(b, o)).alias("alpha"),
    )


@query("stability_score", "F6", f"""WITH {_PAIR}, s AS (
  SELECT *, least(greatest(1 - {_MOVE} / {_DIAG} / 0.35, 0), 1) AS motion,
    CASE WHEN {_INTER} > 0 THEN {_INTER} / {_UNION} ELSE 0 END AS iou,
    exp(-abs(ln(greatest((ox2 - ox1) * (oy2 - oy1), 1) / greatest((x2 - x1) * (y2 - y1), 1)))) AS sc
  FROM pair)
SELECT {KEYS}, {r('motion')} AS motion_score, {r('sc')} AS scale_score,
  {r('0.44 * score + 0.28 * motion + 0.18 * iou + 0.10 * sc')} AS combined FROM s""")
def stability_score(spark, sf):
    s = B.stability_score(_other(), B.Box.of(), F.col("score"))
    return A.boxes(spark, sf).select(
        *KEY, *[tidy(s[c]).alias(c) for c in ("motion_score", "scale_score", "combined")]
    )


@query("candidate_score", "P15", f"""WITH {BOXES}
SELECT {KEYS}, {r(f'''0.30 * least(greatest(1, y2 - y1) / {H}, 1)
 + 0.18 * least(greatest(1, x2 - x1) * greatest(1, y2 - y1) / ({W} * {H}), 1)
 + 0.20 * greatest(0, 1 - abs(greatest(1, x2 - x1) / greatest(1, y2 - y1) - 0.45) / 0.45)
 + 0.12 * least(greatest(y2 / {H}, 0), 1)
 + 0.10 * greatest(0, 1 - abs((x1 + x2) * 0.5 / {W} - 0.42) / 0.42)
 + 0.10 * least(greatest(score / 3, 0), 1)''')} AS candidate_score FROM boxes""")
def candidate_score(spark, sf):
    return A.boxes(spark, sf).select(
        *KEY, tidy(B.candidate_score(B.Box.of(), W, H, F.col("score"))).alias("candidate_score")
    )


@query("box_predicates", "P11,P12,F36", f"""WITH {BOXES}
SELECT {KEYS}, y2 < {H} * 0.985 AS feet_visible, (x2 > x1 AND y2 > y1 AND score > 0.95) AS valid,
 (['#34d399','#60a5fa','#f472b6','#fbbf24','#a78bfa','#fb7185','#4ade80','#38bdf8','#facc15',
   '#c084fc'])[(video_id % 10 + 1)::INT] AS color FROM boxes""")
def box_predicates(spark, sf):
    b = B.Box.of()
    return A.boxes(spark, sf).select(
        *KEY,
        B.feet_visible(b.y2, H).alias("feet_visible"),
        B.valid_box(b, F.col("score") > 0.95).alias("valid"),
        B.track_color(F.col("video_id")).alias("color"),
    )


@query("leg_strip", "F30", f"""WITH {_PAIR}, s AS (
  SELECT *, x1 + 0.30 * (x2 - x1) AS sx1, y1 + 0.55 * (y2 - y1) AS sy1,
    x2 - 0.30 * (x2 - x1) AS sx2, y1 + 0.92 * (y2 - y1) AS sy2 FROM pair)
SELECT {KEYS}, {r('sx1')} AS sx1, {r('sy2')} AS sy2,
 {r('greatest(0, least(sx2, ox2) - greatest(sx1, ox1)) * greatest(0, least(sy2, oy2) - greatest(sy1, oy1)) / ((sx2 - sx1) * (sy2 - sy1))')} AS cover
FROM s""")
def leg_strip(spark, sf):
    s = B.leg_strip(B.Box.of())
    return A.boxes(spark, sf).select(
        *KEY,
        tidy(s.x1).alias("sx1"),
        tidy(s.y2).alias("sy2"),
        tidy(B.strip_cover(s, _other())).alias("cover"),
    )


_PREV = """prev AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS a,
         lag(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS b FROM embeddings)"""


def _with_previous(spark, sf):
    e = A.embeddings(spark, sf).withColumn("all", F.lit(0))
    return neighbourhood(
        e, Line(("all",), "vec_id"), 1, lambda w: {"prev": F.lag("embedding").over(w)}
    )


@query("vector_cosine", "F7", f"""WITH {_PREV}
SELECT vec_id, {r('a[1] / sqrt(list_dot_product(a, a))')} AS unit_first,
  {r('CASE WHEN b IS NOT NULL THEN least(greatest((list_cosine_similarity(a, b) + 1) * 0.5, 0), 1) END')} AS cosine
FROM prev""")
def vector_cosine(spark, sf):
    return _with_previous(spark, sf).select(
        "vec_id",
        tidy(F.element_at(V.l2norm(F.col("embedding")), 1)).alias("unit_first"),
        tidy(V.cosine01(F.col("embedding"), F.col("prev"))).alias("cosine"),
    )


_HIST = _PREV + """, hist AS (
  SELECT vec_id, label, list_transform(a, lambda x: abs(x) / list_sum(list_transform(a, lambda q: abs(q)))) AS p,
   list_transform(b, lambda x: abs(x) / list_sum(list_transform(b, lambda q: abs(q)))) AS q FROM prev)"""
_BINS = """bins AS (SELECT vec_id, unnest(p) AS x, unnest(q) AS y FROM hist WHERE q IS NOT NULL),
sims AS (SELECT vec_id,
   sqrt(greatest(0, 1 - sum(sqrt(x * y)) / sqrt(sum(x) * sum(y)))) AS bh, corr(x, y) AS co,
   sum(least(x, y)) AS it FROM bins GROUP BY vec_id)"""


@query("histogram_similarity", "F8,F9", f"""WITH {_HIST}, {_BINS}
SELECT vec_id, {r('hist.p[3]')} AS share_third,
  {r('CASE WHEN bh IS NOT NULL THEN 0.40 * least(greatest(1 - bh, 0), 1) + 0.35 * least(greatest((co + 1) * 0.5, 0), 1) + 0.25 * least(it, 1) END')} AS similarity
FROM hist LEFT JOIN sims USING (vec_id)""")
def histogram_similarity(spark, sf):
    mag = lambda c: F.transform(F.col(c), lambda x: F.abs(x.cast("double")))
    return _with_previous(spark, sf).select(
        "vec_id",
        tidy(F.element_at(V.l1_normalize(mag("embedding")), 3)).alias("share_third"),
        tidy(V.hist_similarity(mag("embedding"), mag("prev"))).alias("similarity"),
    )


_GALLERY = """g AS (SELECT label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
u AS (SELECT label, k, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM g)"""


@query("gallery_topk", "F10,O6", f"""WITH {_GALLERY},
s AS (SELECT e.vec_id, e.label, list_dot_product(u.v, list_transform(e.embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))) AS sim
  FROM embeddings e JOIN u ON u.label = e.label),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC) AS rk FROM s)
SELECT vec_id, {r('avg(sim)')} AS top5, {r('sum(sim)')} AS total5 FROM k WHERE rk <= 5 GROUP BY vec_id""")
def gallery_topk(spark, sf):
    from stridegrid.operators.joins import best_products, gallery_scores, label_galleries

    e = A.embeddings(spark, sf)
    units = e.select("label", "vec_id", V.l2norm(F.col("embedding")).alias("vec"))
    met = gallery_scores(units, label_galleries(e, 64), "label", best_products(5), V.gallery_best)
    best = F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, 5)
    merged = met.groupBy("vec_id").agg(best.alias("best"))
    sum5 = F.aggregate("best", F.lit(0.0), lambda a, x: a + x)
    return merged.select("vec_id", tidy(sum5 / F.size("best")).alias("top5"), tidy(sum5).alias("total5"))


@query("gallery_max", "F11", f"""WITH {_GALLERY},
h AS (SELECT label, k, list_transform(v, lambda x: abs(x) / list_sum(list_transform(v, lambda q: abs(q)))) AS p FROM u),
e AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: abs(x) / list_sum(list_transform(embedding::DOUBLE[], lambda q: abs(q)))) AS q FROM embeddings),
b AS (SELECT vec_id, k, unnest(p) AS x, unnest(q) AS y FROM e JOIN h USING (label)),
s AS (SELECT vec_id, k, sqrt(greatest(0, 1 - sum(sqrt(x * y)) / sqrt(sum(x) * sum(y)))) AS bh, corr(x, y) AS co, sum(least(x, y)) AS it FROM b GROUP BY vec_id, k)
SELECT vec_id, {r('max(0.40 * least(greatest(1 - bh, 0), 1) + 0.35 * least(greatest((co + 1) * 0.5, 0), 1) + 0.25 * least(it, 1))', 5)} AS best
FROM s GROUP BY vec_id""")
def gallery_max(spark, sf):
    from stridegrid.operators.joins import best_histogram, gallery_scores, label_galleries

    mag = lambda a: F.transform(a, lambda x: F.abs(x.cast("double")))
    e = A.embeddings(spark, sf)
    hists = e.select("label", "vec_id", mag(F.col("embedding")).alias("vec"))
    views = label_galleries(e, 64).withColumn("gallery", F.transform("gallery", mag))
    exact = lambda h, g: F.array(V.gallery_max(h, g))
    met = gallery_scores(hists, views, "label", best_histogram, exact)
    return met.groupBy("vec_id").agg(tidy(F.max(F.get("best", F.lit(0))), 5).alias("best"))


@query("scene_change", "F12", f"""WITH {_PREV},
d AS (SELECT vec_id, unnest(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS d FROM prev WHERE b IS NOT NULL),
m AS (SELECT vec_id, avg(d) AS m FROM d GROUP BY vec_id)
SELECT vec_id, {r('coalesce(m, 0)')} AS diff, coalesce(m >= 0.14, false) AS scene_change FROM prev LEFT JOIN m USING (vec_id)""")
def scene_change(spark, sf):
    from stridegrid.operators.tracks import frame_change

    e = A.embeddings(spark, sf).withColumn("video_id", F.lit(0))
    return frame_change(e, "embedding", 0.14, Line(("video_id",), "vec_id")).select(
        "vec_id", tidy(F.coalesce("diff", F.lit(0.0))).alias("diff"), "scene_change"
    )


def _j(name: int, present=True):
    return P.joint_world(F.col("joints"), name, F.col("subject_present") if present else None)


def sql_angle(a: int, c: int, b: int) -> str:
    d = {ax: (f"({joint(a, ax)} - {joint(c, ax)})", f"({joint(b, ax)} - {joint(c, ax)})")
         for ax in "xyz"}
    dotp = " + ".join(f"{u} * {v}" for u, v in d.values())
    nu = "sqrt(" + " + ".join(f"{u} * {u}" for u, _ in d.values()) + ")"
    nv = "sqrt(" + " + ".join(f"{v} * {v}" for _, v in d.values()) + ")"
    return (f"CASE WHEN present THEN degrees(acos(least(greatest(({dotp}) / ({nu} * {nv}), -1), 1)))"
            " END")


@query("joint_angles", "F13,F14", f"""WITH {POSE}, a AS (SELECT *, {sql_angle(9, 11, 13)} AS k, {sql_angle(5, 9, 11)} AS h FROM pose)
SELECT run_id, frame_index, {r('k')} AS knee_left, {r('h')} AS hip_left,
 {r(f'CASE WHEN present THEN degrees(atan2({joint(11, "x")} - {joint(9, "x")}, {joint(11, "z")} - {joint(9, "z")})) END')} AS thigh_pitch
FROM a""")
def joint_angles(spark, sf):
    p = P.point
    df = P.with_points(A.pose(spark, sf), (5, 9, 11, 13), present=F.col("subject_present"))
    return df.select(
        *RUN,
        tidy(P.angle_between(p(9), p(11), p(13))).alias("knee_left"),
        tidy(P.angle_between(p(5), p(9), p(11))).alias("hip_left"),
        tidy(P.segment_pitch(p(9), p(11))).alias("thigh_pitch"),
    )


def _sag_sql() -> str:
    x, y, z = (lambda j: joint(j, "x")), (lambda j: joint(j, "y")), (lambda j: joint(j, "z"))
    return f"""{POSE}, s1 AS (SELECT *,
  {x(10)} - {x(9)} AS ax, {y(10)} - {y(9)} AS ay,
  {x(15)} - {x(17)} AS lx, {y(15)} - {y(17)} AS ly, {x(18)} - {x(20)} AS rx, {y(18)} - {y(20)} AS ry
  FROM pose WHERE present),
 s2 AS (SELECT *, ax / sqrt(ax*ax + ay*ay) AS ux, ay / sqrt(ax*ax + ay*ay) AS uy,
  (lx / sqrt(lx*lx + ly*ly) + rx / sqrt(rx*rx + ry*ry)) / 2 AS fx,
  (ly / sqrt(lx*lx + ly*ly) + ry / sqrt(rx*rx + ry*ry)) / 2 AS fy FROM s1),
 s3 AS (SELECT *, fx - (fx*ux + fy*uy) * ux AS g0, fy - (fx*ux + fy*uy) * uy AS g1 FROM s2),
 s4 AS (SELECT *, g0 / sqrt(g0*g0 + g1*g1) AS gx, g1 / sqrt(g0*g0 + g1*g1) AS gy FROM s3),
 s5 AS (SELECT *,
  degrees(atan2({z(11)} - {z(9)}, ({x(11)} - {x(9)}) * gx + ({y(11)} - {y(9)}) * gy)) AS thigh,
  degrees(atan2({z(13)} - {z(11)}, ({x(13)} - {x(11)}) * gx + ({y(13)} - {y(11)}) * gy)) AS shank,
  degrees(atan2({z(15)} - {z(17)}, ({x(15)} - {x(17)}) * gx + ({y(15)} - {y(17)}) * gy)) AS foot
  FROM s4)"""


def _wrap(e: str) -> str:
    return f"(({e}) - 360 * ceil((({e}) - 180) / 360))"


@query("sagittal_angles", "F15,F16", f"""WITH {_sag_sql()}
SELECT run_id, frame_index, {r(_wrap('thigh + 90'))} AS hip_left, {r(_wrap('thigh - shank'))} AS knee_left,
 {r(_wrap('foot - (shank + 90)'))} AS ankle_left FROM s5""")
def sagittal_angles(spark, sf):
    df = P.with_points(A.pose(spark, sf).where("subject_present"), P.SAGITTAL_JOINTS)
    return P.with_sagittal_angles(df).select(
        *RUN, *[tidy(F.col(f"{n}_left")).alias(f"{n}_left") for n in ("hip", "knee", "ankle")]
    )


_MID = {ax: f"(({joint(5, ax)} + {joint(6, ax)}) * 0.5)" for ax in "xyz"}
_HIP = {ax: f"(({joint(9, ax)} + {joint(10, ax)}) * 0.5)" for ax in "xyz"}
_FT = {ax: "((" + " + ".join(joint(j, ax) for j in P.FEET) + ") / 8)" for ax in "xyz"}


@query("body_axes", "F17,F18,F19,F20", f"""WITH {POSE}, t AS (SELECT *,
  {', '.join(f'{_MID[a]} - {_HIP[a]} AS t{a}, {_MID[a]} - {_FT[a]} AS u{a}' for a in 'xyz')},
  {', '.join(f'{joint(15, a)} - {joint(17, a)} AS s{a}' for a in 'xyz')} FROM pose),
 q AS (SELECT *, degrees(acos(least(greatest(uz / sqrt(ux*ux + uy*uy + uz*uz), -1), 1))) AS tilt FROM t)
SELECT run_id, frame_index,
 {r(f'atan2({joint(10, "y")} - {joint(9, "y")}, {joint(10, "x")} - {joint(9, "x")})')} AS heading,
 {r('degrees(acos(least(greatest(tz / sqrt(tx*tx + ty*ty + tz*tz), -1), 1)))')} AS lean,
 {r('tilt', 5)} AS tilt,
 {r('CASE WHEN tilt < 2 THEN 0 WHEN tilt <= 25 THEN 1 WHEN tilt >= 50 THEN 0 ELSE 1 - (tilt - 25) / 25 END')} AS upright_weight,
 {r('CASE WHEN sqrt(sx*sx + sy*sy) >= 0.05 THEN atan2(sz, sqrt(sx*sx + sy*sy)) END')} AS sole_pitch
FROM q""")
def body_axes(spark, sf):
    df = P.with_body_up(A.pose(spark, sf))
    df = P.with_points(df, (5, 6, 9, 10, 15, 17))
    df = df.withColumn("_tilt", P.tilt_deg(P.Vec.cols("up")))
    hips = P.midpoint(P.point(9), P.point(10))
    shoulders = P.midpoint(P.point(5), P.point(6))
    return df.select(
        *RUN,
        tidy(P.body_axis_angle(F.col("joints"))).alias("heading"),
        tidy(P.trunk_lean(hips, shoulders)).alias("lean"),
        tidy(F.col("_tilt"), 5).alias("tilt"),
        tidy(P.upright_weight(F.col("_tilt"))).alias("upright_weight"),
        tidy(P.sole_pitch(P.point(15), P.point(17))).alias("sole_pitch"),
    )


@query("pinhole_projection", "F21", f"""WITH {POSE}
SELECT run_id, frame_index, e[36] > 1e-6 AS in_front,
 {r('CASE WHEN e[36] > 1e-6 THEN 900.0 * e[34] / e[36] + 640 END')} AS u,
 {r('CASE WHEN e[36] > 1e-6 THEN 900.0 * e[35] / e[36] + 360 END')} AS v FROM pose""")
def pinhole_projection(spark, sf):
    p = F.get("joints", F.lit(11))
    u, v, ok = B.pinhole_project(p[0], p[1], p[2], F.lit(900.0), W, H)
    return A.pose(spark, sf).select(
        *RUN, ok.alias("in_front"), tidy(u).alias("u"), tidy(v).alias("v")
    )


@query("numeric_helpers", "F22,F23,F24,F31,F37", f"""WITH {SERIES}
SELECT run_id, frame_index,
 {r('1 / (1 + (1 / (2 * pi() * greatest(coalesce(value, 1), 1e-6))) / (1.0 / 30))')} AS alpha,
 {r('CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value / 15, 0), 1) END')} AS severity,
 {r('CASE WHEN value IS NULL THEN 30.0 ELSE value END')} AS value_or_30,
 {r('least(greatest(100.0 * event_id / 9000, 0), 100)')} AS percent,
 12::INT AS surface_frames FROM series""")
def numeric_helpers(spark, sf):
    from stridegrid.operators.tracks import surface_threshold

    v = F.col("value")
    return A.series(spark, sf).select(
        *RUN,
        tidy(N.one_euro_alpha(F.coalesce(v, F.lit(1.0)), F.lit(1.0 / 30))).alias("alpha"),
        tidy(N.camera_motion_severity(v)).alias("severity"),
        tidy(N.numeric_or_default(v, 30.0)).alias("value_or_30"),
        tidy(N.progress_percent(F.col("event_id"), F.lit(9000))).alias("percent"),
        F.lit(surface_threshold(2.0, 30.0, 5)).alias("surface_frames"),
    )


@query("world_coordinates", "P1,P19", f"""WITH {POSE}
SELECT run_id, frame_index, {r(joint(11, 'x'))} AS wx, {r(joint(11, 'y'))} AS wy, {r(joint(11, 'z'))} AS wz,
 {r('e[36]')} AS hand_y, {r('-e[36] + 0.5')} AS shown_x, {r('e[34] - 0.25')} AS shown_y,
 {r(f'CASE WHEN present THEN {joint(20, "z")} END')} AS heel_z FROM pose""")
def world_coordinates(spark, sf):
    raw = F.get("joints", F.lit(11))
    w = P.cam_to_world(raw[0], raw[1], raw[2])
    h = P.hand_to_world(raw[0], raw[1], raw[2])
    d = P.cam_to_display(raw[0], raw[1], raw[2], 0.25, 0.5)
    return A.pose(spark, sf).select(
        *RUN,
        tidy(w.x).alias("wx"),
        tidy(w.y).alias("wy"),
        tidy(w.z).alias("wz"),
        tidy(h.y).alias("hand_y"),
        tidy(d.x).alias("shown_x"),
        tidy(d.y).alias("shown_y"),
        tidy(_j(20).z).alias("heel_z"),
    )


@query("parsed_joints", "P2,P3", f"""WITH {POSE}
SELECT run_id, frame_index, CASE WHEN frame_index % 5 = 0 THEN NULL ELSE 21::BIGINT END AS n_joints,
 {r('CASE WHEN frame_index % 5 = 0 THEN 0 ELSE e[1] END')} AS first_x,
 {r('CASE WHEN frame_index % 3 = 0 THEN 9.0 ELSE e[62] END')} AS comp_x FROM pose""")
def parsed_joints(spark, sf):
    fi = F.col("frame_index")
    broken = F.when(
        fi % 5 == 0, F.transform("joints", lambda j, i: F.when(i == 7, F.slice(j, 1, 2)).otherwise(j))
    ).otherwise(F.col("joints"))
    comp = F.when(fi % 3 == 0, F.array(F.lit(float("nan")), F.lit(1.0), F.lit(2.0))).otherwise(
        F.col("camera_comp")
    )
    parsed = P.parse_joints(broken)
    default = F.array(F.lit(9.0), F.lit(9.0), F.lit(9.0))
    return A.pose(spark, sf).select(
        *RUN,
        F.when(parsed.isNotNull(), F.size(parsed).cast("long")).alias("n_joints"),
        tidy(F.coalesce(F.get(F.get(parsed, F.lit(0)), F.lit(0)), F.lit(0.0))).alias("first_x"),
        tidy(F.get(P.parse_triplet(comp, default), F.lit(0))).alias("comp_x"),
    )


@query("root_position", "P4,P18", f"""WITH {POSE}
SELECT run_id, frame_index,
 {', '.join(f"{r(f'CASE WHEN frame_index % 7 = 0 THEN {joint(9, a)} WHEN frame_index % 4 = 0 THEN {cam} ELSE {_HIP[a]} END')} AS root_{a}" for a, cam in (('x', '(-e[64])'), ('y', 'e[62]'), ('z', '(-e[63])')))},
 present AND frame_index % 9 <> 0 AS meaningful FROM pose""")
def root_position(spark, sf):
    fi = F.col("frame_index")
    bad = F.array(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0))
    one_hip = F.transform("joints", lambda j, i: F.when(i == 10, bad).otherwise(j))
    no_hips = F.transform("joints", lambda j, i: F.when(i.isin(0, 9, 10), bad).otherwise(j))
    joints = F.when(fi % 7 == 0, one_hip).when(fi % 4 == 0, no_hips).otherwise(F.col("joints"))
    df = P.with_root(A.pose(spark, sf).withColumn("joints", joints))
    root = P.Vec.cols("root")
    shown = root.map(lambda c: F.when(fi % 9 == 0, c * 0).otherwise(c))
    return df.select(
        *RUN,
        tidy(root.x).alias("root_x"),
        tidy(root.y).alias("root_y"),
        tidy(root.z).alias("root_z"),
        P.meaningful_root(F.col("subject_present"), shown).alias("meaningful"),
    )


@query("foot_contact", "P9,P10", f"""WITH {POSE}, l AS (SELECT *,
  least({', '.join(joint(j, 'z') for j in P.LEFT_FOOT)}) AS lz, least({', '.join(joint(j, 'z') for j in P.RIGHT_FOOT)}) AS rz,
  ({' + '.join(joint(j, 'x') for j in P.LEFT_FOOT)}) / 4 AS lx, ({' + '.join(joint(j, 'x') for j in P.RIGHT_FOOT)}) / 4 AS rx,
  ({' + '.join(joint(j, 'x') for j in P.FEET)}) / 8 AS bx FROM pose),
 c AS (SELECT *, lz <= least(lz, rz) + 0.055 AS l, rz <= least(lz, rz) + 0.055 AS rr FROM l)
SELECT run_id, frame_index, l AS left_down, rr AS right_down,
 CASE WHEN l AND rr THEN 'both' WHEN l THEN 'left' WHEN rr THEN 'right' ELSE 'none' END AS support,
 {r('CASE WHEN l AND rr THEN bx WHEN l THEN lx ELSE rx END')} AS support_x FROM c""")
def foot_contact(spark, sf):
    return P.with_foot_contact(A.pose(spark, sf)).select(
        *RUN, "left_down", "right_down", "support", tidy(F.col("support_x")).alias("support_x")
    )


@query("frame_status", "P7,P17", f"""WITH {STATUS}
SELECT run_id, frame_index, inference_status,
 CASE WHEN inference_status IN ('masked','subject_absent') THEN false ELSE true END AS subject_present,
 CASE WHEN present THEN 'ok' WHEN inference_status = 'subject_absent' THEN 'subject_lost' ELSE 'subject_lost' END AS record_status,
 CASE WHEN present THEN 'tracked' ELSE 'subject_lost' END AS tracking_status,
 {r('CASE WHEN present THEN score END')} AS tracking_score FROM status""")
def frame_status(spark, sf):
    st = P.record_status(F.col("present"), F.lit(None).cast("string"))
    return A.status(spark, sf).select(
        *RUN,
        "inference_status",
        P.subject_present(
            F.lit(None).cast("boolean"), F.lit(False), F.col("inference_status")
        ).alias("subject_present"),
        st["inference_status"].alias("record_status"),
        st["tracking_status"].alias("tracking_status"),
        tidy(F.when(F.col("present"), F.col("score"))).alias("tracking_score"),
    )


@query("joint_sets", "F34,W26", f"""WITH {POSE}
SELECT run_id, frame_index, {r('least(' + ', '.join(joint(j, 'z') for j in P.FEET) + ')')} AS lowest_foot,
 {r('-greatest(' + ', '.join(f'e[{3 * j + 2}]' for j in range(21)) + ')')} AS lowest_body,
 {r('(' + ' + '.join(joint(j, 'x') for j in (5, 6, 9, 10, 11, 12, 13, 14)) + ') / 8')} AS centroid_x,
 {r('(' + ' + '.join(f'e[{3 * j + 1}]' for j in range(21)) + ') / 21')} AS com_y,
 {r(f'{joint(11, "z")} - {joint(12, "z")}')} AS knee_asymmetry FROM pose""")
def joint_sets(spark, sf):
    j = F.col("joints")
    return P.with_centroid(A.pose(spark, sf)).select(
        *RUN,
        tidy(P.lowest_joint(j, P.FEET)).alias("lowest_foot"),
        tidy(P.lowest_joint(j)).alias("lowest_body"),
        tidy(F.col("centroid_x")).alias("centroid_x"),
        tidy(P.centre_of_mass(j).y).alias("com_y"),
        tidy(_j(11, False).z - _j(12, False).z).alias("knee_asymmetry"),
    )


@query("lerped_joints", "F25", f"""WITH {POSE}, n AS (SELECT *, lead(e) OVER (PARTITION BY run_id ORDER BY frame_index) AS f FROM pose)
SELECT run_id, frame_index, {r('coalesce(e[13] + (f[13] - e[13]) * 0.25, e[13])')} AS x4, {r('coalesce(e[60] + (f[60] - e[60]) * 0.25, e[60])')} AS z19 FROM n""")
def lerped_joints(spark, sf):
    df = neighbourhood(
        A.pose(spark, sf), RUNS, 1, lambda w: {"after": F.lead("joints").over(w)}
    )
    mixed = P.lerp_joints(F.col("joints"), F.col("after"), F.lit(0.25))
    return df.select(
        *RUN,
        tidy(F.get(F.get(mixed, F.lit(4)), F.lit(0))).alias("x4"),
        tidy(F.get(F.get(mixed, F.lit(19)), F.lit(2))).alias("z19"),
    )


@query("padded_rectangle", "F32", f"""WITH {POSE}, p AS (SELECT run_id, frame_index, unnest(range(21)) AS j, e FROM pose),
 q AS (SELECT run_id, frame_index, 640 + 900 * e[3*j+1] AS u, 360 + 900 * e[3*j+2] AS v FROM p),
 s AS (SELECT run_id, frame_index, min(u) AS a, min(v) AS b, max(u) AS c, max(v) AS d FROM q GROUP BY ALL),
 w AS (SELECT *, least(greatest(a - (c - a) * 0.2, 0), {W - 2}) AS x1, least(greatest(b - (d - b) * 0.2, 0), {H - 2}) AS y1 FROM s),
 x AS (SELECT *, least(greatest(c + (c - a) * 0.2, x1 + 1), {W - 1}) AS x2, least(greatest(d + (d - b) * 0.2, y1 + 1), {H - 1}) AS y2 FROM w)
SELECT run_id, frame_index, {', '.join(f"{r(f'CASE WHEN x2 - x1 >= 60 AND y2 - y1 >= 60 THEN {c} END')} AS {c}" for c in ('x1', 'y1', 'x2', 'y2'))} FROM x""")
def padded_rectangle(spark, sf):
    us = F.transform("joints", lambda j: 640 + 900 * F.get(j, F.lit(0)))
    vs = F.transform("joints", lambda j: 360 + 900 * F.get(j, F.lit(1)))
    box = B.rect_pad(
        F.array_min(us), F.array_min(vs), F.array_max(us), F.array_max(vs), F.size("joints"), W, H
    )
    return A.pose(spark, sf).select(
        *RUN, *[tidy(c).alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), box.parts)]
    )


@query("frame_sample", "P8", f"""WITH {SERIES}, s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame_index) AS n FROM series WHERE frame_index >= 4 AND frame_index % 3 = 0)
SELECT run_id, frame_index, event_id FROM s WHERE n <= 10""")
def frame_sample(spark, sf):
    from stridegrid.operators.frames import frame_sampler

    return frame_sampler(A.series(spark, sf), start=4, stride=3, most=10).select(*RUN, "event_id")


@query("joint_names", "P14", """WITH s AS (SELECT unnest(range(21)) AS j, l.run_id FROM (SELECT DISTINCT label::BIGINT AS run_id FROM embeddings) l)
SELECT run_id, j AS joint_id,
 CASE j WHEN 5 THEN 'left_shoulder' WHEN 6 THEN 'right_shoulder' WHEN 9 THEN 'left_hip' WHEN 10 THEN 'right_hip' WHEN 11 THEN 'left_knee' WHEN 12 THEN 'right_knee' WHEN 13 THEN 'left_ankle' WHEN 14 THEN 'right_ankle' WHEN 15 THEN 'left_big_toe' WHEN 16 THEN 'left_small_toe' WHEN 17 THEN 'left_heel' WHEN 18 THEN 'right_big_toe' WHEN 19 THEN 'right_small_toe' WHEN 20 THEN 'right_heel' ELSE 'joint' || lpad(j::VARCHAR, 2, '0') END AS name,
 j::INT AS from_signal FROM s""")
def joint_names(spark, sf):
    runs = A.embeddings(spark, sf).select(F.col("label").alias("run_id")).distinct()
    j = F.col("joint_id")
    return runs.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("joint_id")).select(
        "run_id",
        "joint_id",
        P.joint_label(j).alias("name"),
        P.signal_joint(F.concat(F.lit("joint."), j.cast("string"), F.lit(".z"))).alias("from_signal"),
    )


@query("frame_clock", "F35", f"""WITH {SERIES}, m AS (SELECT run_id, max(frame_index) AS last FROM series GROUP BY run_id)
SELECT run_id, frame_index, {r('(frame_index * 2) / 25.0')} AS source_sec, {r('frame_index / 25.0')} AS processed_sec,
 least(greatest(floor(coalesce(value, 0) / 100 * 25 + 0.5), 0), last)::BIGINT AS at_frame FROM series JOIN m USING (run_id)""")
def frame_clock(spark, sf):
    from stridegrid.operators.frames import frame_at_time, frame_time

    s = A.series(spark, sf)
    last = s.groupBy("run_id").agg(F.max("frame_index").alias("last"))
    fi = F.col("frame_index")
    t = F.coalesce("value", F.lit(0.0)) / 100
    return s.join(last, "run_id").select(
        *RUN,
        tidy(frame_time(fi, fi * 2, F.lit(25.0), "source")).alias("source_sec"),
        tidy(frame_time(fi, fi * 2, F.lit(25.0), "processed")).alias("processed_sec"),
        frame_at_time(t, F.lit(25.0), F.col("last")).alias("at_frame"),
    )
