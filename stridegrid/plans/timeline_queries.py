"""Queries over intervals and the edited timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridegrid.functions.numbers import tidy
from stridegrid.operators import joins as J
from stridegrid.operators import sampling as S
from stridegrid.operators import timeline as TL
from stridegrid.plans.registry import BOXES, SPANS, STATUS, SERIES, query, r
from stridegrid.sources import adapters as A

_MERGED = """cl AS (SELECT run_id, greatest(start_sec, 0) AS s, least(end_sec, 2300) AS e FROM spans WHERE least(end_sec, 2300) - greatest(start_sec, 0) >= 0.05),
pm AS (SELECT *, max(e) OVER (PARTITION BY run_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cl),
gg AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 0.01 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM pm),
merged AS (SELECT run_id, min(s) AS start_sec, max(e) AS end_sec FROM gg GROUP BY run_id, g)"""
_KEY = ["run_id"]


def _merged(spark, sf):
    return TL.merge_intervals(A.spans(spark, sf), _KEY, 0.0, 2300.0)


@query("merge_intervals", "W16", f"WITH {SPANS}, {_MERGED} SELECT * FROM merged")
def merge_intervals(spark, sf):
    return _merged(spark, sf)


@query("keep_ranges", "W17", f"""WITH {SPANS}, {_MERGED}, k AS (SELECT run_id, coalesce(lag(end_sec) OVER w, 0) AS a, start_sec AS b, lead(start_sec) OVER w AS n, end_sec FROM merged WINDOW w AS (PARTITION BY run_id ORDER BY start_sec))
SELECT run_id, a::DOUBLE AS start_sec, b AS end_sec FROM k WHERE b - a >= 0.05 UNION ALL SELECT run_id, end_sec, 2400.0::DOUBLE FROM k WHERE n IS NULL AND 2400.0 - end_sec >= 0.05""")
def keep_ranges(spark, sf):
    return TL.keep_ranges(_merged(spark, sf), _KEY, 0.0, 2400.0)


@query("interval_join", "J8", f"""WITH {SPANS} SELECT p.run_id, p.order_id, q.order_id AS range_id FROM spans p JOIN spans q ON p.run_id = q.run_id AND p.start_sec >= q.start_sec AND p.start_sec < q.end_sec""")
def interval_join(spark, sf):
    s = A.spans(spark, sf)
    points = s.select("run_id", "order_id", F.col("start_sec").alias("t"))
    ranges = s.select("run_id", F.col("order_id").alias("range_id"), "start_sec", "end_sec")
    return J.interval_join(points, ranges, _KEY).select("run_id", "order_id", "range_id")


@query("mask_filter", "P6", f"""WITH {STATUS}, {SPANS} SELECT s.run_id, s.frame_index, EXISTS (SELECT 1 FROM spans q WHERE q.run_id = s.run_id AND s.frame_index / 0.05 >= q.start_sec AND s.frame_index / 0.05 < q.end_sec) AS masked FROM status s""")
def mask_filter(spark, sf):
    frames = A.status(spark, sf).select("run_id", "frame_index")
    return TL.mask_filter(frames, A.spans(spark, sf), 0.05, _KEY)


@query("original_to_edited", "J9", f"""WITH {SPANS}, {_MERGED}, p AS (SELECT run_id, order_id, end_sec + 3 AS t FROM spans)
SELECT p.run_id, p.order_id, {r('greatest(0, t - 100 - coalesce((SELECT sum(greatest(0, least(greatest(m.end_sec, 100), t) - greatest(m.start_sec, 100))) FROM merged m WHERE m.run_id = p.run_id AND m.start_sec < t), 0))')} AS edited FROM p""")
def original_to_edited(spark, sf):
    pts = A.spans(spark, sf).select("run_id", "order_id", (F.col("end_sec") + 3).alias("t"))
    out = TL.original_to_edited(pts, _merged(spark, sf), _KEY, "t", 100.0)
    return out.select("run_id", "order_id", tidy(F.col("edited")).alias("edited"))


_VIS = """cp AS (SELECT DISTINCT run_id, start_sec + 5.5 AS c FROM spans WHERE start_sec + 5.5 > 0.1 AND start_sec + 5.5 < 2399.9),
mk AS (SELECT DISTINCT run_id, 0.0::DOUBLE AS a FROM spans UNION ALL SELECT run_id, c FROM cp),
sg AS (SELECT run_id, a, coalesce(lead(a) OVER (PARTITION BY run_id ORDER BY a), 2400.0) AS b FROM mk),
ov AS (SELECT s.run_id, s.a, s.b, greatest(m.start_sec, s.a) AS ms, least(m.end_sec, s.b) AS me FROM sg s JOIN merged m ON m.run_id = s.run_id AND m.end_sec > s.a AND m.start_sec < s.b),
ov2 AS (SELECT *, lag(me) OVER (PARTITION BY run_id, a ORDER BY ms) AS pe, lead(ms) OVER (PARTITION BY run_id, a ORDER BY ms) AS ns FROM ov),
pc AS (SELECT run_id, coalesce(pe, a) AS s, ms AS e FROM ov2 UNION ALL SELECT run_id, me, b FROM ov2 WHERE ns IS NULL
 UNION ALL SELECT run_id, a, b FROM sg s WHERE NOT EXISTS (SELECT 1 FROM ov o WHERE o.run_id = s.run_id AND o.a = s.a)),
vis AS (SELECT run_id, s AS start_sec, e AS end_sec, row_number() OVER w AS index, coalesce(sum(e - s) OVER (PARTITION BY run_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS display_start FROM pc WHERE e - s >= 0.1 WINDOW w AS (PARTITION BY run_id ORDER BY s))"""


def _visible(spark, sf):
    s = A.spans(spark, sf)
    bounds = s.select("run_id").distinct().withColumns({"trim_start": F.lit(0.0), "trim_end": F.lit(2400.0)})
    cuts = s.select("run_id", (F.col("start_sec") + 5.5).alias("cut_sec")).distinct()
    return TL.visible_segments(bounds, cuts, _merged(spark, sf), _KEY)


@query("visible_segments", "W18", f"""WITH {SPANS}, {_MERGED}, {_VIS} SELECT run_id, index, {r('start_sec')} AS start_sec, {r('end_sec')} AS end_sec, {r('display_start')} AS display_start FROM vis""")
def visible_segments(spark, sf):
    return _visible(spark, sf).select(
        "run_id", "index", *[tidy(F.col(c)).alias(c) for c in ("start_sec", "end_sec", "display_start")]
    )


@query("timeline_remap", "J10", f"""WITH {SPANS}, {_MERGED}, {_VIS}, v AS (SELECT *, display_start + end_sec - start_sec AS display_end FROM vis), l AS (SELECT run_id, max(display_end) AS last FROM v GROUP BY run_id),
p AS (SELECT run_id, order_id, least(greatest(start_sec + 0.25, 0), last) AS off, start_sec + 0.25 AS t, last FROM spans JOIN l USING (run_id)),
a AS (SELECT p.run_id, p.order_id, p.off, min(v.index) AS i FROM p JOIN v ON v.run_id = p.run_id AND p.off <= v.display_end + 0.001 GROUP BY ALL),
b AS (SELECT p.run_id, p.order_id, min(v.index) AS i FROM p LEFT JOIN v ON v.run_id = p.run_id AND p.t <= v.end_sec GROUP BY ALL)
SELECT p.run_id, p.order_id, {r('least(greatest(va.start_sec + p.off - va.display_start, va.start_sec), va.end_sec)')} AS original,
 {r('CASE WHEN vb.index IS NULL THEN p.last ELSE vb.display_start + least(greatest(p.t - vb.start_sec, 0), vb.end_sec - vb.start_sec) END')} AS "offset"
FROM p JOIN a USING (run_id, order_id) JOIN b USING (run_id, order_id) JOIN v va ON va.run_id = p.run_id AND va.index = a.i LEFT JOIN v vb ON vb.run_id = p.run_id AND vb.index = b.i""")
def timeline_remap(spark, sf):
    pts = A.spans(spark, sf).select("run_id", "order_id", (F.col("start_sec") + 0.25).alias("t"))
    vis = _visible(spark, sf)
    back = TL.edited_to_original(pts, vis, _KEY).select("run_id", "order_id", "original")
    fwd = TL.timeline_offset(pts, vis, _KEY).select("run_id", "order_id", "offset")
    return back.join(fwd, ["run_id", "order_id"]).select(
        "run_id", "order_id", tidy(F.col("original")).alias("original"), tidy(F.col("offset")).alias("offset")
    )


_ANCH = """an AS (SELECT video_id AS run_id, frame * 1 AS f, x1, y1, x2, y2 FROM boxes WHERE det_id = 0 AND frame % 3 = 0),
st AS (SELECT *, lead(f) OVER w AS nf, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2 FROM an WINDOW w AS (PARTITION BY run_id ORDER BY f)),
md AS (SELECT run_id, greatest(1, floor(quantile_cont((nf - f)::DOUBLE, 0.5))) AS stride FROM st WHERE nf IS NOT NULL GROUP BY run_id)"""


@query("densify_anchors", "W21", f"""WITH {BOXES}, {_ANCH},
ex AS (SELECT st.*, unnest(CASE WHEN nf - f > 1 AND nf - f <= greatest(2, 3 * coalesce(stride, 1)) THEN range(0, nf - f) ELSE [0] END) AS k FROM st LEFT JOIN md USING (run_id)),
li AS (SELECT *, k::DOUBLE / greatest(nf - f, 1) AS t FROM ex)
SELECT run_id, f + k AS frame_index, {r('CASE WHEN k = 0 THEN x1 ELSE least(greatest((1-t)*x1 + t*nx1, 0), 1278) END')} AS x1,
 {r('CASE WHEN k = 0 THEN y2 ELSE least(greatest((1-t)*y2 + t*ny2, least(greatest((1-t)*y1 + t*ny1, 0), 718) + 1), 719) END')} AS y2 FROM li""")
def densify_anchors(spark, sf):
    an = A.boxes(spark, sf).where("det_id = 0 AND frame % 3 = 0").withColumnRenamed("video_id", "run_id")
    an = an.withColumnRenamed("frame", "frame_index")
    out = S.densify_anchors(an, A.WIDTH, A.HEIGHT)
    return out.select("run_id", "frame_index", tidy(F.col("x1")).alias("x1"), tidy(F.col("y2")).alias("y2"))


@query("spread_pick", "O3", f"""WITH {SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY start_sec, order_id) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM spans),
w AS (SELECT DISTINCT run_id, CASE WHEN n <= 4 THEN j ELSE round_even(j * (n - 1) / 3.0, 0)::BIGINT END AS i FROM o, range(4) t(j))
SELECT run_id, order_id FROM o SEMI JOIN w USING (run_id, i)""")
def spread_pick(spark, sf):
    s = A.spans(spark, sf)
    return S.spread_pick(s, ["run_id"], ["start_sec", "order_id"], F.floor(F.col("start_sec") / 4096), 4).select("run_id", "order_id")


@query("scan_times", "O4", f"""WITH {SPANS}, {_MERGED}, tot AS (SELECT run_id, sum(end_sec - start_sec) AS kept FROM merged GROUP BY run_id),
g AS (SELECT m.run_id, round_even(m.start_sec + k * greatest(1, t.kept / 20), 3) AS t FROM merged m JOIN tot t USING (run_id), range(0, 4000) q(k) WHERE m.start_sec + k * greatest(1, t.kept / 20) < m.end_sec),
d AS (SELECT DISTINCT run_id, t FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM d),
w AS (SELECT DISTINCT run_id, CASE WHEN n <= 20 THEN j ELSE round_even(j * (n - 1) / 19.0, 0)::BIGINT END AS i FROM o, range(20) t(j))
SELECT run_id, {r('t')} AS t FROM o SEMI JOIN w USING (run_id, i)""")
def scan_times(spark, sf):
    out = S.scan_times(_merged(spark, sf), ["run_id"], budget=20)
    return out.select("run_id", tidy(F.col("t")).alias("t"))


@query("sample_results", "O5", f"""WITH {SPANS}, o AS (SELECT *, order_id % 3 = 0 AS hit, row_number() OVER (PARTITION BY run_id, order_id % 3 = 0 ORDER BY start_sec, order_id) - 1 AS i, count(*) OVER (PARTITION BY run_id, order_id % 3 = 0) AS n FROM spans),
h AS (SELECT run_id, count(*) AS hits FROM o WHERE hit GROUP BY run_id),
k AS (SELECT o.*, CASE WHEN hit THEN 5 ELSE greatest(0, 5 - coalesce(hits, 0)) END AS k FROM o LEFT JOIN h USING (run_id)),
w AS (SELECT DISTINCT run_id, hit, CASE WHEN n <= k THEN j WHEN k = 1 THEN n // 2 ELSE round_even(j * (n - 1) / (k - 1.0), 0)::BIGINT END AS i FROM k, range(5) t(j) WHERE j < k)
SELECT run_id, order_id, hit FROM k SEMI JOIN w USING (run_id, hit, i)""")
def sample_results(spark, sf):
    s = A.spans(spark, sf).withColumn("hit", F.col("order_id") % 3 == 0)
    return S.sample_results(s, ["run_id"], "hit", ["start_sec", "order_id"], F.floor(F.col("start_sec") / 4096), 5).select("run_id", "order_id", "hit")
