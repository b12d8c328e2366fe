"""Queries over gait, the analysis signals and the low-pass filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridegrid.functions import pose as P
from stridegrid.functions.numbers import tidy
from stridegrid.operators import aggregates as AG
from stridegrid.operators import events as E
from stridegrid.operators import gait as G
from stridegrid.operators import recurrences as R
from stridegrid.operators import signals as S
from stridegrid.operators import windows as W
from stridegrid.plans import analysis as AN
from stridegrid.plans.registry import POSE, SERIES, STATUS, joint, query, r
from stridegrid.plans.scalar_queries import sql_angle
from stridegrid.sources import adapters as A

RUN = ["run_id", "frame_index"]
WIN = "PARTITION BY run_id ORDER BY frame_index"


def _filter_sql() -> str:
    b, a = R.lowpass_coefficients(30.0, 6.0)
    zi = R.ChunkFilter.of(b, a).settled
    B, Z = [repr(float(v)) for v in b], [repr(float(v)) for v in zi]
    Ac = [repr(float(v)) for v in a]

    def one_pass(name: str, src: str) -> str:
        y = f"({B[0]} * n.x + p.z0)"
        tail = ", ".join(
            f"{B[i]} * n.x - {Ac[i]} * {y} + {f'p.z{i}' if i < 4 else '0'} AS z{i - 1}" for i in range(1, 5)
        )
        first = ", ".join(f"{Z[i]} * x AS z{i}" for i in range(4))
        return f"""{name}0 AS (SELECT run_id, i, x, {first} FROM {src} WHERE i = 0),
{name} AS (SELECT run_id, -1::BIGINT AS i, NULL::DOUBLE AS y, z0, z1, z2, z3 FROM {name}0
 UNION ALL SELECT n.run_id, n.i, {y}, {tail} FROM {name} p JOIN {src} n ON n.run_id = p.run_id AND n.i = p.i + 1)"""

    return f"""WITH RECURSIVE {SERIES}, fl AS (SELECT run_id, frame_index, value,
 last_value(CASE WHEN value IS NOT NULL THEN frame_index END IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ai,
 last_value(value IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS av,
 first_value(CASE WHEN value IS NOT NULL THEN frame_index END IGNORE NULLS) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bi,
 first_value(value IGNORE NULLS) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bv FROM series),
f AS (SELECT run_id, frame_index AS k, value, CASE WHEN ai IS NULL THEN bv WHEN bi IS NULL OR ai = bi THEN av ELSE av + (bv - av) * (frame_index - ai) / (bi - ai) END AS x FROM fl),
n AS (SELECT run_id, count(*) AS n, count(value) AS m, arg_min(x, k) AS x0, arg_max(x, k) AS x1 FROM f GROUP BY run_id),
ext AS (SELECT f.run_id, k + 15 AS i, x FROM f UNION ALL SELECT f.run_id, 15 - k, 2 * x0 - x FROM f JOIN n USING (run_id) WHERE k BETWEEN 1 AND 15
 UNION ALL SELECT f.run_id, n + 15 + (n - 2 - k), 2 * x1 - x FROM f JOIN n USING (run_id) WHERE k BETWEEN n - 16 AND n - 2),
{one_pass('fw', 'ext')},
rev AS (SELECT fw.run_id, n + 29 - i AS i, y AS x FROM fw JOIN n USING (run_id) WHERE i >= 0),
{one_pass('bw', 'rev')},
res AS (SELECT bw.run_id, n + 29 - i - 15 AS frame_index, y FROM bw JOIN n USING (run_id) WHERE i >= 0)
SELECT f.run_id, f.k AS frame_index, {r('CASE WHEN n.n <= 15 OR n.m < 8 THEN f.value WHEN f.value IS NOT NULL THEN res.y END')} AS smooth
FROM f JOIN n USING (run_id) LEFT JOIN res ON res.run_id = f.run_id AND res.frame_index = f.k"""


@query("zero_phase_lowpass", "G1", _filter_sql())
def zero_phase_lowpass(spark, sf):
    df = A.series(spark, sf).select(*RUN, F.col("value").alias("smooth"))
    return R.zero_phase_lowpass(df, ["smooth"], 30.0).withColumn("smooth", tidy(F.col("smooth")))


_STAT = f"""ps AS (SELECT q.run_id, q.frame_index, present AND vec_id % 11 <> 0 AS ok, {', '.join(f"({joint(9, a)} + {joint(10, a)}) * 0.5 AS h{a}, ({joint(5, a)} + {joint(6, a)}) * 0.5 AS s{a}" for a in 'xyz')} FROM pose q),
d AS (SELECT *, CASE WHEN frame_index = 0 THEN lead(hx) OVER ({WIN}) - hx ELSE hx - lag(hx) OVER ({WIN}) END AS dx, CASE WHEN frame_index = 0 THEN lead(hy) OVER ({WIN}) - hy ELSE hy - lag(hy) OVER ({WIN}) END AS dy,
 degrees(acos(least(greatest((sz-hz) / sqrt(power(sx-hx,2)+power(sy-hy,2)+power(sz-hz,2)), -1), 1))) AS lean FROM ps),
c AS (SELECT *, ok AND sqrt(dx*dx + dy*dy) * 0.3 <= 0.08 AND lean <= 120 AS quiet FROM d),
g AS (SELECT *, frame_index - row_number() OVER (PARTITION BY run_id, quiet ORDER BY frame_index) AS isle FROM c),
l AS (SELECT *, quiet AND count(*) OVER (PARTITION BY run_id, quiet, isle) >= 2 AS long_run FROM g)"""


def _static(spark, sf):
    df = P.with_points(A.pose(spark, sf), (5, 6, 9, 10, *P.SAGITTAL_JOINTS))
    ok = F.col("vec_id") % 11 != 0
    return df.withColumns({"left": ok, "right": ok})


@query("static_frames", "W15", f"""WITH {POSE}, {_STAT} SELECT run_id, frame_index, coalesce(long_run, false) AS static FROM l""")
def static_frames(spark, sf):
    return G.static_frames(_static(spark, sf), 0.3, max_lean=120.0, min_run=2, min_total=0).select(*RUN, "static")


@query("neutral_offset", "A9", f"""WITH {POSE}, {_STAT}, a AS (SELECT q.run_id, q.frame_index, {sql_angle(9, 11, 13)} - 90 AS k, {sql_angle(5, 9, 11)} - 90 AS h FROM pose q),
s AS (SELECT l.run_id, count(*) FILTER (long_run) AS static_frames, count(k) FILTER (long_run) AS n1, count(h) FILTER (long_run) AS n2, quantile_cont(k, 0.5) FILTER (long_run) AS mk, quantile_cont(h, 0.5) FILTER (long_run) AS mh FROM l JOIN a USING (run_id, frame_index) GROUP BY l.run_id)
SELECT run_id, static_frames, coalesce(least(n1, n2) >= 4 AND greatest(abs(mk), abs(mh)) <= 45, false) AS applied, CASE WHEN least(n1, n2) >= 4 AND greatest(abs(mk), abs(mh)) <= 45 THEN round(mk, 3) END AS offset_knee_left FROM s""")
def neutral_offset(spark, sf):
    df = G.static_frames(_static(spark, sf), 0.3, max_lean=120.0, min_run=2, min_total=0)
    p = P.point
    df = df.withColumns(
        {
            "knee_left": F.when(F.col("subject_present"), P.angle_between(p(9), p(11), p(13)) - 90),
            "hip_left": F.when(F.col("subject_present"), P.angle_between(p(5), p(9), p(11)) - 90),
        }
    )
    out = G.neutral_offset(df, 0.3, angles=("knee_left", "hip_left"))
    return out.select("run_id", "static_frames", "applied", "offset_knee_left")


_EV = f"""onoff AS (SELECT run_id, frame_index, "left" AND present AS l, "right" AND present AS rr FROM status),
e AS (SELECT *, lag(l) OVER ({WIN}) AS wl, lag(rr) OVER ({WIN}) AS wr FROM onoff),
ev AS (SELECT run_id, frame_index, 'left' AS side, CASE WHEN l THEN 'heel_strike' ELSE 'toe_off' END AS type FROM e WHERE l <> wl
 UNION ALL SELECT run_id, frame_index, 'right', CASE WHEN rr THEN 'heel_strike' ELSE 'toe_off' END FROM e WHERE rr <> wr)"""


def _events(spark, sf):
    s = A.status(spark, sf)
    out = None
    for side in ("left", "right"):
        e = W.contact_edges(s, side, "present").select(*RUN, "type").withColumn("side", F.lit(side))
        out = e if out is None else out.unionByName(e)
    return out


@query("steps", "W8", f"""WITH {STATUS}, {_EV}, hs AS (SELECT *, lead(side) OVER w AS ns, lead(frame_index) OVER w AS nf FROM ev WHERE type = 'heel_strike' WINDOW w AS (PARTITION BY run_id ORDER BY frame_index, side))
SELECT run_id, side, ns AS end_side, frame_index AS start_frame, nf AS end_frame, {r('(nf - frame_index) / 10.0')}::DOUBLE AS duration_s FROM hs WHERE ns <> side""")
def steps(spark, sf):
    return E.steps(_events(spark, sf), 10.0).withColumn("duration_s", tidy(F.col("duration_s")))


_STR = f"""st AS (SELECT run_id, side, frame_index AS a, lead(frame_index) OVER (PARTITION BY run_id, side ORDER BY frame_index) AS b FROM ev WHERE type = 'heel_strike')"""


@query("double_support", "A7", f"""WITH {STATUS}, {_EV}, {_STR}
SELECT st.run_id, st.side, a AS start_frame, b AS end_frame, {r('100.0 * avg((o.l AND o.rr)::INT)')} AS double_support_pct FROM st JOIN onoff o ON o.run_id = st.run_id AND o.frame_index >= a AND o.frame_index < b WHERE b IS NOT NULL GROUP BY ALL""")
def double_support(spark, sf):
    s = A.status(spark, sf)
    contact = s.select(*RUN, *[(F.col(c) & F.col("present")).alias(c) for c in ("left", "right")])
    out = AG.double_support(E.strides(_events(spark, sf), 10.0), contact)
    return out.select("run_id", "side", "start_frame", "end_frame", tidy(F.col("double_support_pct")).alias("double_support_pct"))


_STV = f"""{_STR}, sv AS (SELECT st.*, (b - a) / 9.7::DOUBLE AS d, p.score AS pa, q.score AS pb, (SELECT min(frame_index) FROM ev WHERE ev.run_id = st.run_id AND ev.side = st.side AND type = 'toe_off' AND frame_index > a AND frame_index < b) AS t
 FROM st JOIN status p ON p.run_id = st.run_id AND p.frame_index = a JOIN status q ON q.run_id = st.run_id AND q.frame_index = b WHERE (b - a) / 9.7 BETWEEN 0.4 AND 3.0),
sm AS (SELECT *, abs(pb - pa) / 100 AS len FROM sv), hs AS (SELECT run_id, side, frame_index, lead(side) OVER w AS ns, lead(frame_index) OVER w AS nf FROM ev WHERE type = 'heel_strike' WINDOW w AS (PARTITION BY run_id ORDER BY frame_index, side)),
sp AS (SELECT run_id, (nf - frame_index) / 9.7::DOUBLE AS d FROM hs WHERE ns <> side AND (nf - frame_index) / 9.7 BETWEEN 0.2 AND 3.0),
pa AS (SELECT run_id, avg(len / d) AS spd, count(*) AS n, avg(d) AS std, coalesce(stddev_samp(d), 0) AS sds, avg(100.0 * (t - a) / (b - a)) AS stance FROM sm GROUP BY run_id),
pb AS (SELECT run_id, avg(d) AS stp FROM sp GROUP BY run_id)"""


@query("spatiotemporal", "A6", f"""WITH {STATUS}, {_EV}, {_STV}
SELECT r.run_id, coalesce(spd >= 0.10 AND n >= 2, false) AS walking_detected, round(60.0 / stp, 2) AS cadence, round(std, 4) AS stride_time_mean, round(sds, 4) AS stride_time_sd, coalesce(n, 0) AS stride_time_n,
 CASE WHEN spd >= 0.10 THEN round(spd, 4) END AS walking_speed_mean, round(stance, 4) AS stance_pct_mean FROM (SELECT DISTINCT run_id FROM status) r LEFT JOIN pa USING (run_id) LEFT JOIN pb USING (run_id)""")
def spatiotemporal(spark, sf):
    s = A.status(spark, sf)
    ev = _events(spark, sf)
    pos = F.col("score") / 100
    base = s.select(
        *RUN, "left", "right", F.col("present").alias("subject_present"),
        pos.alias("w17_x"), F.lit(0.0).alias("w17_y"), pos.alias("w20_x"), F.lit(0.0).alias("w20_y"),
    )
    out = G.spatiotemporal(base, G.measured_strides(base, ev, 9.7), G.measured_steps(base, ev, 9.7))
    return out.select(
        "run_id", "walking_detected", F.col("cadence_steps_per_min").alias("cadence"), "stride_time_mean",
        "stride_time_sd", "stride_time_n", "walking_speed_mean", "stance_pct_mean",
    )


_CYC = f"""{_STR}, sg AS (SELECT run_id, frame_index, CASE WHEN event_id % 9 <> 0 THEN score END AS v FROM status),
cy AS (SELECT st.run_id, st.side, st.a, st.b - st.a AS len, g.frame_index - st.a AS o, g.v FROM st JOIN sg g ON g.run_id = st.run_id AND g.frame_index BETWEEN a AND b WHERE (b - a) / 10.0 BETWEEN 0.4 AND 3.0 AND b - a >= 4),
fl AS (SELECT *, count(v) OVER c / (len + 1.0) AS share, last_value(CASE WHEN v IS NOT NULL THEN o END IGNORE NULLS) OVER w AS ao, last_value(v IGNORE NULLS) OVER w AS av, first_value(CASE WHEN v IS NOT NULL THEN o END IGNORE NULLS) OVER x AS bo, first_value(v IGNORE NULLS) OVER x AS bv FROM cy
 WINDOW c AS (PARTITION BY run_id, side, a), w AS (PARTITION BY run_id, side, a ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY run_id, side, a ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
bf AS (SELECT run_id, side, a, len, o, CASE WHEN ao IS NULL THEN bv WHEN bo IS NULL OR ao = bo THEN av ELSE av + (bv - av) * (o - ao) / (bo - ao) END AS f FROM fl WHERE share >= 0.8),
pt AS (SELECT DISTINCT run_id, side, a, len, p AS pct, p * len / 100.0::DOUBLE AS at, (p * len) // 100 AS lo FROM bf, range(101) t(p)),
rs AS (SELECT pt.run_id, pt.side, pt.a, pt.pct, u.f + (coalesce(v.f, u.f) - u.f) * (pt.at - pt.lo) AS value FROM pt JOIN bf u ON u.run_id = pt.run_id AND u.side = pt.side AND u.a = pt.a AND u.o = pt.lo LEFT JOIN bf v ON v.run_id = pt.run_id AND v.side = pt.side AND v.a = pt.a AND v.o = pt.lo + 1)"""


def _cycles(spark, sf):
    s = A.status(spark, sf)
    sig = s.select(*RUN, F.lit("v").alias("signal_id"), F.when(F.col("event_id") % 9 != 0, F.col("score")).alias("value"))
    return G.resample_cycles(sig, E.strides(_events(spark, sf), 10.0))


@query("resample_cycles", "W20", f"""WITH {STATUS}, {_EV}, {_CYC} SELECT run_id, side, a AS cycle_id, pct, {r('value')} AS value FROM rs""")
def resample_cycles(spark, sf):
    return _cycles(spark, sf).select("run_id", "side", "cycle_id", "pct", tidy(F.col("value")).alias("value"))


@query("cycle_curve", "A8", f"""WITH {STATUS}, {_EV}, {_CYC} SELECT run_id, side, pct, {r('avg(value)', 3)} AS mean, {r('coalesce(stddev_samp(value), 0)', 3)} AS sd, count(*) AS n_cycles FROM rs GROUP BY ALL""")
def cycle_curve(spark, sf):
    return _cycles(spark, sf).groupBy("run_id", "side", "pct").agg(
        tidy(F.avg("value"), 3).alias("mean"), tidy(AG.sample_sd(F.col("value")), 3).alias("sd"), F.count("value").alias("n_cycles")
    )


@query("analysis_signals", "W27,G2,G5,G6,W13")
def analysis_signals(spark, sf):
    return S.to_long(AN.analysis_signals(A.pose(spark, sf), 30.0), AN.SIGNALS).withColumn("value", tidy(F.col("value"), 5))


def _derived_sql() -> str:
    pts = {5: "s_l", 11: "k_l", 12: "k_r", 13: "a_l", 14: "a_r", 17: "h_l"}
    cols = ", ".join(
        f"CASE WHEN present THEN {joint(j, a)} END AS {n}{a}" for j, n in pts.items() for a in "xyz"
    )
    speed = lambda n: "sqrt(" + " + ".join(f"power({n}{a} - lag({n}{a}) OVER ({WIN}), 2)" for a in "xyz") + ") * 30"
    return f"""WITH {POSE}, p AS (SELECT run_id, frame_index, {cols}, {sql_angle(9, 11, 13)} AS ka, {sql_angle(10, 12, 14)} AS kb, {sql_angle(5, 9, 11)} AS ha FROM pose),
s AS (SELECT *, {speed('k_l')} AS ks, {speed('a_l')} AS asl, {speed('a_r')} AS asr, {speed('h_l')} AS hs FROM p),
f AS (SELECT run_id, arg_min(k_lx, frame_index) AS fx, arg_min(k_ly, frame_index) AS fy, arg_min(k_lz, frame_index) AS fz FROM p WHERE k_lx IS NOT NULL GROUP BY run_id),
w AS (SELECT s.*, (ks - lag(ks) OVER ({WIN})) * 30 AS kacc, (ha - lag(ha) OVER ({WIN})) * 30 AS hrate, (k_lz - lag(k_lz) OVER ({WIN})) * 30 AS kvz, sqrt(power(k_lx-fx,2)+power(k_ly-fy,2)+power(k_lz-fz,2)) AS kd FROM s JOIN f USING (run_id)),
u AS (SELECT run_id, frame_index, unnest([struct_pack(i := 'joint.knee.left.angle_deg', v := ka), struct_pack(i := 'joint.hip.left.angle_deg', v := ha), struct_pack(i := 'joint.hip.left.angular_velocity_deg', v := hrate),
 struct_pack(i := 'joint.knee.left.vz', v := kvz), struct_pack(i := 'joint.knee.left.speed', v := ks), struct_pack(i := 'joint.knee.left.acceleration', v := kacc), struct_pack(i := 'joint.knee.left.distance', v := kd),
 struct_pack(i := 'joint.heel.left.speed', v := hs), struct_pack(i := 'joint.shoulder.left.z', v := s_lz), struct_pack(i := 'asymmetry.knee.angle_deg', v := ka - kb), struct_pack(i := 'asymmetry.ankle.speed', v := asl - asr)]) AS q FROM w)
SELECT run_id, frame_index, q.i AS signal_id, {r('q.v', 5)} AS value FROM u"""


_SHOWN = {
    "joint.knee.left.angle_deg", "joint.hip.left.angle_deg", "joint.hip.left.angular_velocity_deg", "joint.knee.left.vz",
    "joint.knee.left.speed", "joint.knee.left.acceleration", "joint.knee.left.distance", "joint.heel.left.speed",
    "joint.shoulder.left.z", "asymmetry.knee.angle_deg", "asymmetry.ankle.speed",
}


@query("derived_signals_checked", "W28", _derived_sql())
def derived_signals_checked(spark, sf):
    names = {c: i for c, i in S.DERIVED.items() if i in _SHOWN}
    return S.to_long(S.derived_signals(A.pose(spark, sf), 30.0), names).withColumn("value", tidy(F.col("value"), 5))


@query("derived_signals", "W28")
def derived_signals(spark, sf):
    return S.to_long(S.derived_signals(A.pose(spark, sf), 30.0), S.DERIVED).withColumn("value", tidy(F.col("value"), 5))


@query("upright_series", "G4")
def upright_series(spark, sf):
    from stridegrid.operators.display import upright_series

    df = P.with_body_up(A.pose(spark, sf), present=F.col("subject_present"))
    out = upright_series(df, 30.0)
    return out.select(*RUN, *[tidy(F.col(c), 5).alias(c) for c in ("q_w", "q_x", "q_y", "q_z")])


@query("gait_cycles", "G1,F15,G7,W20,A8")
def gait_cycles(spark, sf):
    pose = A.pose(spark, sf)
    contacts = pose.select(*RUN, (F.col("vec_id") % 9 < 5).alias("left"), (F.col("vec_id") % 8 < 4).alias("right"))
    return AN.gait_layer(pose, contacts, 10.0)["cycles"]


@query("run_quality_report", "A4,W27")
def run_quality_report(spark, sf):
    frames = A.pose(spark, sf)
    return AN.analyze(frames, 30.0)["parameters"]
