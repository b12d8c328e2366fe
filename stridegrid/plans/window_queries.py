"""Queries over the time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridegrid.functions import pose as P
from stridegrid.functions.numbers import tidy
from stridegrid.operators import events as E
from stridegrid.operators import recurrences as R
from stridegrid.operators import windows as W
from stridegrid.operators.frames import view_window
from stridegrid.operators.tracks import scene_segments
from stridegrid.plans.blocks import Line
from stridegrid.plans.registry import BOXES, POSE, SERIES, STATUS, joint, query, r
from stridegrid.sources import adapters as A

RUN = ["run_id", "frame_index"]
WIN = "PARTITION BY run_id ORDER BY frame_index"


@query("rolling_mean", "W1,W2", f"""WITH {SERIES}
SELECT run_id, frame_index, {r(f'avg(value) OVER ({WIN} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS mean7,
 {r(f'coalesce(avg(value) OVER ({WIN} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), value)')} AS mean3 FROM series""")
def rolling_mean(spark, sf):
    df = W.rolling_mean(A.series(spark, sf), 6, mean7="value")
    df = W.smooth_xy(df.withColumn("mean3", F.col("value")).withColumn("m2", F.col("value")), "mean3", "m2", 1)
    return df.select(*RUN, tidy(F.col("mean7")).alias("mean7"), tidy(F.col("mean3")).alias("mean3"))


@query("edge_padded_mean", "W3", f"""WITH {SERIES}, v AS (SELECT *, coalesce(value, 0) AS x,
 first_value(coalesce(value, 0)) OVER (PARTITION BY run_id ORDER BY frame_index) AS a,
 last_value(coalesce(value, 0)) OVER (PARTITION BY run_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b,
 count(*) OVER (PARTITION BY run_id) AS n FROM series)
SELECT run_id, frame_index, {r(f'''(sum(x) OVER ({WIN} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 2 - frame_index) * a + greatest(0, 2 - (n - 1 - frame_index)) * b) / 5''')} AS mean5 FROM v""")
def edge_padded_mean(spark, sf):
    df = A.series(spark, sf).withColumn("x", F.coalesce("value", F.lit(0.0)))
    return W.edge_padded_mean(df, 5, mean5="x").select(*RUN, tidy(F.col("mean5")).alias("mean5"))


_P3 = lambda j: ", ".join(joint(j, a) for a in "xyz")
_XYZ = f"""pts AS (SELECT run_id, frame_index, CASE WHEN present THEN {joint(11, 'x')} END AS x,
 CASE WHEN present THEN {joint(11, 'y')} END AS y, CASE WHEN present THEN {joint(11, 'z')} END AS z FROM pose)"""


def _knee(spark, sf):
    df = P.with_points(A.pose(spark, sf), (11,), present=F.col("subject_present"))
    return df.select(*RUN, *[F.col(f"w11_{a}").alias(a) for a in "xyz"])


@query("derivatives", "W4", f"""WITH {POSE}, {_XYZ}, d AS (SELECT *, x - lag(x) OVER ({WIN}) AS dx, y - lag(y) OVER ({WIN}) AS dy, z - lag(z) OVER ({WIN}) AS dz FROM pts)
SELECT run_id, frame_index, {r('dz * 30')} AS vz, {r('sqrt(dx*dx + dy*dy + dz*dz) * 30')} AS speed FROM d""")
def derivatives(spark, sf):
    df = W.derivative(_knee(spark, sf), 30.0, vz="z")
    df = W.speed(df, 30.0, speed=("x", "y", "z"))
    return df.select(*RUN, tidy(F.col("vz")).alias("vz"), tidy(F.col("speed")).alias("speed"))


@query("slip_speed", "W5", f"""WITH {POSE}, {_XYZ},
p AS (SELECT *, last_value(x IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS px, last_value(y IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS py FROM pts)
SELECT run_id, frame_index, {r('sqrt((x-px)*(x-px) + (y-py)*(y-py)) * 30')} AS slip FROM p""")
def slip_speed(spark, sf):
    df = W.slip_speed(_knee(spark, sf), 30.0, slip=("x", "y"))
    return df.select(*RUN, tidy(F.col("slip")).alias("slip"))


@query("baseline_distance", "W6", f"""WITH {POSE}, {_XYZ},
f AS (SELECT run_id, arg_min(x, frame_index) AS fx, arg_min(y, frame_index) AS fy, arg_min(z, frame_index) AS fz FROM pts WHERE x IS NOT NULL GROUP BY run_id)
SELECT run_id, frame_index, {r('sqrt((x-fx)*(x-fx) + (y-fy)*(y-fy) + (z-fz)*(z-fz))')} AS distance FROM pts JOIN f USING (run_id)""")
def baseline_distance(spark, sf):
    df = W.baseline_distance(_knee(spark, sf), distance=("x", "y", "z"))
    return df.select(*RUN, tidy(F.col("distance")).alias("distance"))


@query("carry_forward", "W7", f"""WITH {SERIES}
SELECT run_id, frame_index, {r(f'coalesce(last_value(value IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)')} AS held FROM series""")
def carry_forward(spark, sf):
    df = W.carry_forward(A.series(spark, sf), held="value")
    return df.select(*RUN, tidy(F.col("held")).alias("held"))


@query("linear_gap_fill", "W19", f"""WITH {SERIES}, s AS (SELECT *,
 last_value(CASE WHEN value IS NOT NULL THEN frame_index END IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ai,
 last_value(value IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS av,
 first_value(CASE WHEN value IS NOT NULL THEN frame_index END IGNORE NULLS) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bi,
 first_value(value IGNORE NULLS) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bv FROM series)
SELECT run_id, frame_index, {r('CASE WHEN ai IS NULL THEN bv WHEN bi IS NULL OR ai = bi THEN av ELSE av + (bv - av) * (frame_index - ai) / (bi - ai) END')} AS filled FROM s""")
def linear_gap_fill(spark, sf):
    df = W.linear_gap_fill(A.series(spark, sf), filled="value")
    return df.select(*RUN, tidy(F.col("filled")).alias("filled"))


_ON = """onoff AS (SELECT *, ("left" AND present) AS on_now FROM status)"""


@query("contact_edges", "W9", f"""WITH {STATUS}, {_ON}, e AS (SELECT *, lag(on_now) OVER ({WIN}) AS was FROM onoff)
SELECT run_id, frame_index, CASE WHEN on_now THEN 'heel_strike' ELSE 'toe_off' END AS type FROM e WHERE on_now <> was""")
def contact_edges(spark, sf):
    return W.contact_edges(A.status(spark, sf), "left", "present").select(*RUN, "type")


@query("refined_minimum", "W10", f"""WITH {SERIES}, w AS (SELECT *, min(value) OVER ({WIN} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM series)
SELECT a.run_id, a.frame_index, coalesce(min(b.frame_index), a.frame_index) AS at_frame FROM w a LEFT JOIN series b ON a.run_id = b.run_id AND b.frame_index BETWEEN a.frame_index - 4 AND a.frame_index + 4 AND b.value = a.m GROUP BY a.run_id, a.frame_index""")
def refined_minimum(spark, sf):
    return W.argmin_nearby(A.series(spark, sf), "value", 4, "at_frame").select(*RUN, "at_frame")


_SMOOTH = f"""src AS (SELECT run_id, frame_index, coalesce(value, 0) / 1000 AS h, (event_id % 13) / 50.0 AS x, (event_id % 7) / 50.0 AS y FROM series),
ends AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, {', '.join(f"first_value({c}) OVER ({WIN}) AS {c}0, last_value({c}) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS {c}1" for c in 'hxy')} FROM src),
sm AS (SELECT run_id, frame_index, n, {', '.join(f"(sum({c}) OVER ({WIN} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + greatest(0, 1 - frame_index) * {c}0 + greatest(0, 1 - (n - 1 - frame_index)) * {c}1) / 3 AS {c}" for c in 'hxy')} FROM ends),
dd AS (SELECT *, last_value(x) OVER w - first_value(x) OVER w AS dx, last_value(y) OVER w - first_value(y) OVER w AS dy, lag(h) OVER ({WIN}) AS hp, lead(h) OVER ({WIN}) AS hn FROM sm WINDOW w AS ({WIN} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
dp AS (SELECT *, sqrt(dx*dx + dy*dy) AS disp FROM dd),
q AS (SELECT run_id, quantile_cont(h, 0.12) AS f, greatest(0.012, (quantile_cont(h, 0.88) - quantile_cont(h, 0.25)) * 0.35) AS lt, greatest(0.010, quantile_cont(disp, 0.65) * 0.35) AS mt FROM dp GROUP BY run_id),
pk AS (SELECT run_id, frame_index, greatest(h - f, 0) AS lift FROM dp JOIN q USING (run_id)
 WHERE n >= 5 AND hp IS NOT NULL AND hn IS NOT NULL AND greatest(h - f, 0) >= lt AND disp >= mt AND greatest(h - f, 0) >= greatest(hp - f, 0) AND greatest(h - f, 0) >= greatest(hn - f, 0))"""


def _path(spark, sf):
    return A.series(spark, sf).select(
        *RUN,
        (F.coalesce("value", F.lit(0.0)) / 1000).alias("h"),
        ((F.col("event_id") % 13) / 50.0).alias("x"),
        ((F.col("event_id") % 7) / 50.0).alias("y"),
    )


@query("local_peaks", "W11", f"""WITH {SERIES}, {_SMOOTH} SELECT run_id, frame_index, {r('lift')} AS lift FROM pk""")
def local_peaks(spark, sf):
    df = W.foot_lift_candidates(_path(spark, sf), "x", "y", "h", 30.0)
    return df.select(*RUN, tidy(F.col("lift")).alias("lift"))


_CAND = f"""cand AS (SELECT run_id, frame_index, value AS lift, row_number() OVER ({WIN}) AS k FROM series WHERE value > 30)"""


@query("min_gap_peaks", "G5", f"""WITH RECURSIVE {SERIES}, {_CAND},
fold AS (SELECT run_id, k, frame_index AS kept, lift AS kl, 1 AS slot FROM cand WHERE k = 1
 UNION ALL SELECT c.run_id, c.k, CASE WHEN c.frame_index - f.kept >= 8 OR c.lift > f.kl THEN c.frame_index ELSE f.kept END,
  CASE WHEN c.frame_index - f.kept >= 8 OR c.lift > f.kl THEN c.lift ELSE f.kl END,
  CASE WHEN c.frame_index - f.kept >= 8 THEN f.slot + 1 ELSE f.slot END
 FROM fold f JOIN cand c ON c.run_id = f.run_id AND c.k = f.k + 1),
lastk AS (SELECT run_id, slot, max(k) AS k FROM fold GROUP BY run_id, slot)
SELECT f.run_id, f.kept AS frame_index, {r('f.kl')} AS lift FROM fold f JOIN lastk USING (run_id, slot, k)""")
def min_gap_peaks(spark, sf):
    ev = A.series(spark, sf).where("value > 30").select(*RUN, F.col("value").alias("lift"))
    return E.min_gap_peaks(ev, 8).select(*RUN, tidy(F.col("lift")).alias("lift"))


_REFR = f"""ev AS (SELECT run_id, frame_index, side, row_number() OVER (PARTITION BY run_id ORDER BY frame_index, side) AS k FROM (
  SELECT run_id, frame_index, 'left' AS side FROM status WHERE "left" AND event_id % 3 = 0 UNION ALL
  SELECT run_id, frame_index, 'right' FROM status WHERE "right" AND event_id % 4 = 0)),
fold AS (SELECT run_id, k, frame_index AS kept, side, true AS took, true AS alternates FROM ev WHERE k = 1
 UNION ALL SELECT e.run_id, e.k, CASE WHEN e.frame_index - f.kept >= 7 THEN e.frame_index ELSE f.kept END,
  CASE WHEN e.frame_index - f.kept >= 7 THEN e.side ELSE f.side END, e.frame_index - f.kept >= 7,
  e.side <> f.side FROM fold f JOIN ev e ON e.run_id = f.run_id AND e.k = f.k + 1),
steps AS (SELECT run_id, kept AS frame_index, side, alternates FROM fold WHERE took)"""


def _step_events(spark, sf):
    s = A.status(spark, sf)
    left = s.where(F.col("left") & (F.col("event_id") % 3 == 0))
    right = s.where(F.col("right") & (F.col("event_id") % 4 == 0))
    return s, E.refractory_events(left, right, 30.0)


@query("refractory_events", "G6", f"WITH RECURSIVE {STATUS}, {_REFR} SELECT * FROM steps")
def refractory_events(spark, sf):
    return _step_events(spark, sf)[1]


@query("step_state", "W13", f"""WITH RECURSIVE {STATUS}, {_REFR},
alt AS (SELECT run_id, frame_index, 30.0 / (frame_index - lag(frame_index) OVER ({WIN})) AS cad FROM steps WHERE alternates),
j AS (SELECT s.run_id, s.frame_index, a.frame_index AS af, a.cad FROM status s LEFT JOIN alt a USING (run_id, frame_index)),
h AS (SELECT run_id, frame_index, af, last_value(cad IGNORE NULLS) OVER ({WIN}) AS cad, last_value(af IGNORE NULLS) OVER ({WIN}) AS la FROM j)
SELECT run_id, frame_index, CASE WHEN af IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS effective_event, {r('cad::DOUBLE')} AS cadence_hz, {r('coalesce((frame_index - la) / 30.0, 0)::DOUBLE')} AS since_step_s FROM h""")
def step_state(spark, sf):
    s, ev = _step_events(spark, sf)
    return E.step_state(s.select(*RUN), ev, 30.0).select(
        *RUN, "effective_event", tidy(F.col("cadence_hz")).alias("cadence_hz"),
        tidy(F.col("since_step_s")).alias("since_step_s"),
    )


@query("expected_step_interval", "A10", f"""WITH RECURSIVE {STATUS}, {_REFR},
alt AS (SELECT run_id, (frame_index - lag(frame_index) OVER ({WIN})) / 30.0 AS s FROM steps WHERE alternates),
q AS (SELECT run_id, quantile_cont(s::DOUBLE, 0.65) AS q FROM alt WHERE s BETWEEN 0.2 AND 2.5 GROUP BY run_id)
SELECT DISTINCT run_id, {r('least(greatest(coalesce(q, 0.85), 0.45), 1.60)')} AS expected_interval_s FROM steps LEFT JOIN q USING (run_id)""")
def expected_step_interval(spark, sf):
    out = E.expected_step_interval(_step_events(spark, sf)[1], 30.0)
    return out.select("run_id", tidy(F.col("expected_interval_s")).alias("expected_interval_s"))


@query("gap_limited_edges", "G7", f"""WITH RECURSIVE {STATUS}, {_ON}, e AS (SELECT *, lag(on_now) OVER ({WIN}) AS was FROM onoff),
ed AS (SELECT run_id, frame_index, CASE WHEN on_now THEN 'heel_strike' ELSE 'toe_off' END AS type FROM e WHERE on_now <> was),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, type ORDER BY frame_index) AS k FROM ed),
fold AS (SELECT run_id, type, k, frame_index AS kept, true AS took FROM n WHERE k = 1
 UNION ALL SELECT n.run_id, n.type, n.k, CASE WHEN n.frame_index - f.kept >= 8 THEN n.frame_index ELSE f.kept END, n.frame_index - f.kept >= 8
 FROM fold f JOIN n ON n.run_id = f.run_id AND n.type = f.type AND n.k = f.k + 1)
SELECT run_id, 'left' AS side, type, kept AS frame_index FROM fold WHERE took""")
def gap_limited_edges(spark, sf):
    edges = W.contact_edges(A.status(spark, sf), "left", "present").withColumn("side", F.lit("left"))
    return E.gap_limited_edges(edges, 8).select("run_id", "side", "type", "frame_index")


_ANGLE = f"atan2({joint(10, 'y')} - {joint(9, 'y')}, {joint(10, 'x')} - {joint(9, 'x')})"


@query("unwrapped_heading", "W12", f"""WITH {POSE}, a AS (SELECT run_id, frame_index, CASE WHEN present THEN {_ANGLE} END AS t FROM pose),
p AS (SELECT *, last_value(t IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt, lag(t) OVER ({WIN}) AS lt FROM a),
d AS (SELECT *, coalesce((2*(t-pt) - 2*pi()*round(2*(t-pt)/(2*pi())))/2, 0) AS turn, abs(2*(t-lt) - 2*pi()*round(2*(t-lt)/(2*pi())))/2 * 30 * 180 / pi() AS rate FROM p),
f AS (SELECT run_id, arg_min(t, frame_index) AS t0 FROM a WHERE t IS NOT NULL GROUP BY run_id)
SELECT run_id, frame_index, {r(f'CASE WHEN t IS NOT NULL THEN t0 + sum(turn) OVER ({WIN}) END')} AS heading,
 {r(f'avg(rate) OVER ({WIN} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)', 5)} AS yaw_rate FROM d JOIN f USING (run_id)""")
def unwrapped_heading(spark, sf):
    df = A.pose(spark, sf).select(
        *RUN, F.when(F.col("subject_present"), P.body_axis_angle(F.col("joints"))).alias("t")
    )
    df = W.yaw_rate(W.unwrap_axial(df, "t", "heading"), "t", 30.0, "yaw_rate")
    return df.select(*RUN, tidy(F.col("heading")).alias("heading"), tidy(F.col("yaw_rate"), 5).alias("yaw_rate"))


@query("islands", "W14", f"""WITH {STATUS}, g AS (SELECT *, frame_index - row_number() OVER ({WIN}) AS isle FROM status WHERE ambiguous)
SELECT run_id, min(frame_index) AS "start", max(frame_index) AS "end", count(*) AS length FROM g GROUP BY run_id, isle""")
def islands(spark, sf):
    return W.islands(A.status(spark, sf), "ambiguous")


@query("scene_segments", "W22", f"""WITH {STATUS}, l AS (SELECT *, NOT present AS is_cut, lag(NOT present) OVER ({WIN}) AS was FROM status),
o AS (SELECT *, CASE WHEN NOT is_cut AND coalesce(was, false) THEN 1 ELSE 0 END AS opens FROM l)
SELECT run_id, frame_index, CASE WHEN NOT is_cut THEN sum(opens) OVER ({WIN}) END::BIGINT AS segment_id FROM o""")
def scene_segments_query(spark, sf):
    df = A.status(spark, sf).withColumn("scene_change", ~F.col("present"))
    return scene_segments(df, line=Line()).select(*RUN, "segment_id")


@query("view_window", "W25", f"""WITH {SERIES}, m AS (SELECT run_id, max(frame_index) AS last FROM series GROUP BY run_id),
w AS (SELECT s.*, greatest(0, least(50, last - 20 + 1)) AS lo FROM series s JOIN m USING (run_id))
SELECT run_id, frame_index, event_id FROM w WHERE frame_index >= lo AND frame_index < lo + 20""")
def view_window_query(spark, sf):
    s = A.series(spark, sf)
    df = W.per_key(s, Line(), F.max("frame_index").alias("last"))
    return view_window(df, F.lit(50), F.lit(20), F.col("last")).select(*RUN, "event_id")


_SUP = f"""sup AS (SELECT run_id, frame_index, event_id % 4 <> 0 AS ok, CASE WHEN event_id % 4 = 0 THEN 'none' WHEN event_id % 3 = 0 THEN 'left' ELSE 'both' END AS support,
 coalesce(value, 0) / 100 AS s, frame_index * 0.01 AS root FROM series)"""


def _support(spark, sf):
    eid = F.col("event_id")
    s = F.coalesce("value", F.lit(0.0)) / 100
    return A.series(spark, sf).select(
        *RUN,
        F.when(eid % 4 == 0, "none").when(eid % 3 == 0, "left").otherwise("both").alias("support"),
        F.when(eid % 4 != 0, s).alias("support_x"),
        F.when(eid % 4 != 0, s * 0).alias("support_y"),
        (F.col("frame_index") * 0.01).alias("root_x"),
        F.lit(0.0).alias("root_y"),
    )


@query("support_stabilize", "G2", f"""WITH RECURSIVE {SERIES}, {_SUP},
rec AS (SELECT run_id, frame_index, support, 0.0::DOUBLE AS c, CASE WHEN ok THEN s END AS a, root FROM sup WHERE frame_index = 0
 UNION ALL SELECT n.run_id, n.frame_index, n.support,
  CASE WHEN n.ok THEN rec.c * 0.78 + ((CASE WHEN rec.a IS NULL OR n.support <> rec.support THEN n.s + rec.c ELSE rec.a END) - n.s) * 0.22 ELSE rec.c END,
  CASE WHEN n.ok AND (rec.a IS NULL OR n.support <> rec.support) THEN n.s + rec.c ELSE rec.a END, n.root
 FROM rec JOIN sup n ON n.run_id = rec.run_id AND n.frame_index = rec.frame_index + 1)
SELECT run_id, frame_index, {r(f'avg(root + c) OVER ({WIN} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)')} AS stable_x FROM rec""")
def support_stabilize(spark, sf):
    df = R.support_stabilize(_support(spark, sf), 30.0)
    return df.select(*RUN, tidy(F.col("support_root_x")).alias("stable_x"))


@query("anchor_trajectory", "W23", f"""WITH {SERIES}, {_SUP},
l AS (SELECT *, lag(support) OVER ({WIN}) AS ps, lag(s) OVER ({WIN}) AS pv FROM sup)
SELECT run_id, frame_index, {r(f"root + sum(CASE WHEN ok AND ps = support THEN pv - s ELSE 0 END) OVER ({WIN})")} AS anchored_x FROM l""")
def anchor_trajectory(spark, sf):
    from stridegrid.operators.display import anchor_trajectory

    return anchor_trajectory(_support(spark, sf), limit_m=1e9).select(
        *RUN, tidy(F.col("anchored_x")).alias("anchored_x")
    )


@query("anchor_trajectory_limited", "W23", f"""WITH RECURSIVE {SERIES}, {_SUP},
rec AS (SELECT run_id, frame_index, CASE WHEN ok THEN support ELSE 'none' END AS ls, 0.0::DOUBLE AS c, CASE WHEN ok THEN s END AS a, root FROM sup WHERE frame_index = 0
 UNION ALL SELECT n.run_id, n.frame_index, CASE WHEN n.ok THEN n.support ELSE 'none' END,
  CASE WHEN n.ok THEN least(greatest((CASE WHEN rec.a IS NULL OR n.support <> rec.ls THEN n.s + rec.c ELSE rec.a END) - n.s, -0.5), 0.5) ELSE rec.c END,
  CASE WHEN n.ok AND (rec.a IS NULL OR n.support <> rec.ls) THEN n.s + rec.c ELSE rec.a END, n.root
 FROM rec JOIN sup n ON n.run_id = rec.run_id AND n.frame_index = rec.frame_index + 1)
SELECT run_id, frame_index, {r('root + c')} AS anchored_x FROM rec""")
def anchor_trajectory_limited(spark, sf):
    from stridegrid.operators.display import anchor_trajectory

    return anchor_trajectory(_support(spark, sf), limit_m=0.5).select(
        *RUN, tidy(F.col("anchored_x")).alias("anchored_x")
    )


_EURO = """rec AS (SELECT run_id, frame_index, v, v AS x, CASE WHEN v IS NOT NULL THEN 0.0::DOUBLE END AS d FROM sig WHERE frame_index = 0
 UNION ALL SELECT n.run_id, n.frame_index, n.v,
  CASE WHEN n.v IS NULL THEN rec.x WHEN rec.x IS NULL THEN n.v ELSE rec.x + (1 / (1 + (1 / (2 * pi() * ({m} + {b} * abs(rec.d + {a} * ((n.v - rec.x) * 30 - rec.d))))) * 30)) * (n.v - rec.x) END,
  CASE WHEN n.v IS NULL THEN rec.d WHEN rec.x IS NULL THEN 0.0 ELSE rec.d + {a} * ((n.v - rec.x) * 30 - rec.d) END
 FROM rec JOIN sig n ON n.run_id = rec.run_id AND n.frame_index = rec.frame_index + 1)"""
_AD = "(1 / (1 + 30 / (2 * pi())))"


ONE_EURO_SQL = f"""WITH RECURSIVE {SERIES}, sig AS (SELECT run_id, frame_index, value / 100 AS v FROM series),
{_EURO.format(m=1.0, b=0.3, a=_AD)} SELECT run_id, frame_index, {r('CASE WHEN v IS NOT NULL THEN x END')} AS smooth FROM rec"""


@query("one_euro", "G3", ONE_EURO_SQL)
def one_euro(spark, sf):
    df = A.series(spark, sf).withColumn("v", F.col("value") / 100)
    return R.one_euro(df, 30.0, {"smooth": ("v", *R.ONE_EURO["x"])}).select(
        *RUN, tidy(F.col("smooth")).alias("smooth")
    )


@query("lift_series", "W24", f"""WITH RECURSIVE {SERIES}, raw AS (SELECT run_id, frame_index, value / 100 AS z FROM series),
o AS (SELECT run_id, z, row_number() OVER (PARTITION BY run_id ORDER BY z) - 1 AS k, count(*) OVER (PARTITION BY run_id) AS n FROM raw WHERE z IS NOT NULL),
g AS (SELECT run_id, z AS ground FROM o WHERE k = least(n - 1, floor(n * 0.10))),
sig AS (SELECT run_id, frame_index, z - ground AS v FROM raw JOIN g USING (run_id)),
{_EURO.format(m=1.5, b=0.6, a=_AD)} SELECT run_id, frame_index, {r('CASE WHEN v IS NULL THEN 0 ELSE greatest(0, x - 0.05) END')} AS lift FROM rec""")
def lift_series(spark, sf):
    from stridegrid.operators.display import lift_series

    df = A.series(spark, sf).withColumn("z", F.col("value") / 100)
    return lift_series(df, "z", 30.0).select(*RUN, tidy(F.col("lift")).alias("lift"))


@query("ema", "G12", f"""WITH RECURSIVE {SERIES},
rec AS (SELECT run_id, frame_index, value AS y FROM series WHERE frame_index = 0
 UNION ALL SELECT n.run_id, n.frame_index, CASE WHEN n.value IS NULL THEN rec.y WHEN rec.y IS NULL THEN n.value ELSE 0.65 * rec.y + 0.35 * n.value END
 FROM rec JOIN series n ON n.run_id = rec.run_id AND n.frame_index = rec.frame_index + 1)
SELECT run_id, frame_index, {r('coalesce(y, 0)')} AS mean FROM rec""")
def ema(spark, sf):
    return R.ema(A.series(spark, sf), "value", 0.35, "mean").select(*RUN, tidy(F.col("mean")).alias("mean"))


_TRACK = """trk AS (SELECT video_id AS run_id, frame AS f0, x1, y1, x2, y2, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS frame_index FROM boxes WHERE det_id = 0)"""


def first_boxes(spark, sf):
    """First detection per frame, numbered along the video."""
    from stridegrid.plans.blocks import dense_position

    b = A.boxes(spark, sf).where("det_id = 0").withColumnRenamed("video_id", "run_id")
    return dense_position(b, ["run_id"], ["frame"], F.floor(F.col("frame") / 65536))


@query("adaptive_box_ema", "G11", f"""WITH RECURSIVE {BOXES}, {_TRACK},
rec AS (SELECT run_id, frame_index, x1 AS a, y1 AS b, x2 AS c, y2 AS d FROM trk WHERE frame_index = 0
 UNION ALL SELECT run_id, frame_index, w*x1+(1-w)*a, w*y1+(1-w)*b, w*x2+(1-w)*c, w*y2+(1-w)*d FROM (
  SELECT n.*, rec.a, rec.b, rec.c, rec.d, 0.55 + 0.40 * least(1, sqrt(power((n.x1+n.x2-rec.a-rec.c)/2, 2) + power((n.y1+n.y2-rec.b-rec.d)/2, 2)) / sqrt(power(n.x2-n.x1, 2) + power(n.y2-n.y1, 2)) / 0.10) AS w
  FROM rec JOIN trk n ON n.run_id = rec.run_id AND n.frame_index = rec.frame_index + 1))
SELECT run_id, frame_index, {r('a', 5)} AS smooth_x1, {r('d', 5)} AS smooth_y2 FROM rec""")
def adaptive_box_ema(spark, sf):
    df = R.adaptive_box_ema(first_boxes(spark, sf))
    return df.select(*RUN, tidy(F.col("smooth_x1"), 5).alias("smooth_x1"), tidy(F.col("smooth_y2"), 5).alias("smooth_y2"))
