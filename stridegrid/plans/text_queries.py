"""Queries over prompts, names, labels and signal groups, on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridegrid.functions import boxes as B
from stridegrid.functions import pose as P
from stridegrid.functions import text as TX
from stridegrid.functions.numbers import tidy
from stridegrid.operators.signals import DERIVED, default_signals
from stridegrid.plans.registry import SERIES, query, r
from stridegrid.sources import adapters as A


@query("prompt_lists", "F26", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,;|]'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS p, unnest(range(len(w))) AS i FROM s), f AS (SELECT doc_id, lower(p) AS k, min(i) AS i, arg_min(p, i) AS p FROM u GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f), g AS (SELECT doc_id, list(p ORDER BY i) AS ps FROM n WHERE n <= 8 GROUP BY doc_id)
SELECT d.doc_id, coalesce(array_to_string(ps, '#'), 'person') AS prompts FROM documents d LEFT JOIN g USING (doc_id)""")
def prompt_lists(spark, sf):
    d = A.prompts(spark, sf)
    return d.select("doc_id", F.array_join(TX.split_prompts(F.col("text")), "#").alias("prompts"))


@query("canonical_prompts", "F26", """WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'hand' WHEN 1 THEN 'person' WHEN 2 THEN 'hand' WHEN 3 THEN 'Blue coat' ELSE 'hand' END AS a FROM documents)
SELECT doc_id, CASE WHEN a = 'hand' THEN 'hand#' || lang ELSE a || '#hand#' || lang END AS prompts FROM (SELECT d.*, lang FROM d JOIN documents USING (doc_id))""")
def canonical_prompts(spark, sf):
    k = F.col("doc_id") % 5
    first = F.when(k == 0, "Only Hand").when(k == 1, "just person").when(k == 2, " main ").when(k == 3, "Blue coat").otherwise("HAND ONLY")
    raw = F.array(first, F.lit(""), F.lit("la main"), F.col("lang"), F.lit("hand only"))
    return A.prompts(spark, sf).select("doc_id", F.array_join(TX.canonical_prompts(raw), "#").alias("prompts"))


_CLAUSE = "'with','holding','carrying','wearing','in','on','near','behind','beside','that','who','having','and'"


@query("prompt_variants", "F27", rf"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[,;|]')) AS p, unnest(range(len(regexp_split_to_array(text, '[,;|]')))) AS pos FROM documents),
b AS (SELECT doc_id, pos, regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS base FROM p),
t AS (SELECT doc_id, pos, base, string_split(base, ' ') AS w FROM b),
c AS (SELECT doc_id, pos, base, w, list_reverse(list_filter(range(1, len(w)), lambda i: regexp_replace(lower(w[i + 1]), '^[,.;]+|[,.;]+$', '', 'g') IN ({_CLAUSE}))) AS cuts FROM t),
v AS (SELECT doc_id, pos, base, [base] || list_transform(cuts, lambda i: array_to_string(w[1:i], ' ')) AS vs FROM c)
SELECT doc_id, pos::INT AS pos, CASE WHEN base = '' THEN 'person' ELSE array_to_string(vs, '#') || CASE WHEN len(list_filter(vs, lambda x: lower(x) = 'person')) > 0 THEN '' ELSE '#person' END END AS variants FROM v""")
def prompt_variants(spark, sf):
    d = A.prompts(spark, sf).select("doc_id", F.posexplode(F.split("text", "[,;|]")).alias("pos", "p"))
    return d.select("doc_id", "pos", F.array_join(TX.simplify_chain(F.col("p")), "#").alias("variants"))


@query("safe_names", "F28", r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[^a-zA-Z0-9_-]+', '_', 'g'), '_+', '_', 'g') AS t, text FROM documents)
SELECT doc_id, CASE WHEN regexp_replace(t, '^_+|_+$', '', 'g') = '' THEN 'run' ELSE regexp_replace(t, '^_+|_+$', '', 'g') END AS token, CASE WHEN text = '' THEN 'export' ELSE substr(regexp_replace(text, '[^a-zA-Z0-9._-]+', '_', 'g'), 1, 120) END AS file_name,
 regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' AND NOT contains(text, '/') AND NOT contains(text, '\') AS valid_id FROM a""")
def safe_names(spark, sf):
    t = F.col("text")
    return A.prompts(spark, sf).select(
        "doc_id", TX.safe_token(t).alias("token"), TX.safe_file_name(t).alias("file_name"), TX.valid_run_id(t).isNotNull().alias("valid_id")
    )


@query("time_labels", "F29,F38", f"""WITH {SERIES}, s AS (SELECT *, coalesce(value, -1) * 7 AS sec FROM series), l AS (SELECT *, floor(event_id * 3 / 24.0 + 0.5)::BIGINT AS q FROM s)
SELECT run_id, frame_index, floor(greatest(sec, 0) / 60)::BIGINT || ':' || printf('%05.2f', greatest(sec, 0) - floor(greatest(sec, 0) / 60) * 60) AS timecode, floor(frame_index / 24.0 * 1000 + 0.5)::BIGINT AS ms,
 CASE WHEN event_id = 0 THEN '' WHEN q >= 3600 THEN (q // 3600) || 'h' || CASE WHEN q % 3600 // 60 > 0 THEN (q % 3600 // 60) || 'min' ELSE '' END WHEN q >= 60 THEN (q // 60) || 'min' || CASE WHEN q % 60 > 0 THEN (q % 60) || 's' ELSE '' END ELSE q || 's' END AS duration FROM l""")
def time_labels(spark, sf):
    sec = F.coalesce("value", F.lit(-1.0)) * 7
    return A.series(spark, sf).select(
        "run_id", "frame_index", TX.format_timecode(sec).alias("timecode"),
        TX.timestamp_ms(F.col("frame_index"), F.lit(24.0)).alias("ms"),
        TX.duration_label(F.col("event_id") * 3, F.lit(24.0)).alias("duration"),
    )


@query("parsed_boxes", "F33", """WITH p AS (SELECT o_orderkey AS id, o_orderkey % 800 AS a, o_orderkey % 700 + 20 AS b, o_orderkey % 9 AS m, (o_orderkey % 100) / 90.0 AS f FROM orders)
SELECT id, CASE WHEN m NOT IN (0, 1) AND b > a THEN a::DOUBLE END AS x1, CASE WHEN m NOT IN (0, 1) AND b > a THEN b::DOUBLE END AS x2, round(CASE WHEN f > 0.95 AND FALSE THEN 0 ELSE least(greatest(f, 0), 0.98) END + 3e-11, 6) AS crop_x, round(least(greatest(0.5, 0.05), 1 - least(greatest(f, 0), 0.98)) + 3e-11, 6) AS crop_w FROM p""")
def parsed_boxes(spark, sf):
    k = F.col("o_orderkey")
    a, b, m = k % 800, k % 700 + 20, k % 9
    text = F.when(m == 0, F.concat(a.cast("string"), F.lit(",x,3,4"))).when(m == 1, F.lit("1,2,3")).otherwise(
        F.concat(a.cast("string"), F.lit(", 10,"), b.cast("string"), F.lit(",90"))
    )
    box = B.parse_box(text)
    f = (k % 100) / 90.0
    x, y, w, h = TX.parse_crop(F.concat(f.cast("string"), F.lit(",0.1,0.5,0.5")))
    return A.table(spark, sf, "orders").select(
        k.alias("id"), box.x1.alias("x1"), box.x2.alias("x2"), F.round(x + 3e-11, 6).alias("crop_x"), F.round(w + 3e-11, 6).alias("crop_w")
    )


@query("signal_groups", "P13,O2")
def signal_groups(spark, sf):
    ids = list(DERIVED.values())
    unit = lambda i: (
        "deg/s" if "velocity" in i else "deg" if i.endswith("_deg") else "m/s^2" if "acceleration" in i
        else "m/s" if i.endswith((".vz", ".speed")) else "m"
    )
    rows = F.array(*[F.struct(F.lit(i).alias("signal_id"), F.lit(i).alias("label"), F.lit(unit(i)).alias("unit")) for i in ids])
    runs = A.embeddings(spark, sf).select(F.col("label").alias("run_id")).distinct()
    cat = runs.select("run_id", F.explode(rows).alias("s")).select("run_id", "s.*")
    return default_signals(cat, [9, 10, 11, 12, 13, 14])
