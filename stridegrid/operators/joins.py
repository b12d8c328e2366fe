"""Joins: overlap, similarity, intervals, as-of."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridegrid.functions.boxes import Box, iou, iou_floored, leg_strip, strip_cover
from stridegrid.functions.numbers import round_half_up
from stridegrid.functions.vectors import l2norm
from stridegrid.plans.blocks import DEFAULT_BLOCK_ROWS, RUNS, Line, for_python, neighbourhood, running
from stridegrid.plans.quantiles import exact_quantiles
from stridegrid.plans.session import cut, one_blas_thread


def label_galleries(vectors: DataFrame, views: int = 256) -> DataFrame:
    """(label, part, gallery): all unit vectors of each label, in parts of about ``views``.

    A label of any size is cut by a hash of the vector id, so no task or array
    holds a whole label; what is taken from a gallery (best cosines, largest
    similarity) is taken from each part and merged.
    """
    sizes = vectors.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / views).alias("_parts"))
    dealt = vectors.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("_parts")))
    return dealt.groupBy("label", "part").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))),
            lambda s: l2norm(s["embedding"]),
        ).alias("gallery")
    )


# --- overlap joins -----------------------------------------------------------

CORNERS = ("x1", "y1", "x2", "y2")


def _cells(df: DataFrame, cell: float, prefix: str) -> DataFrame:
    """One row per picture cell a box touches."""
    span = lambda a, b: F.sequence(
        F.floor(F.col(f"{prefix}{a}") / cell), F.floor(F.greatest(f"{prefix}{a}", f"{prefix}{b}") / cell)
    )
    return df.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn(
        "_cy", F.explode(span("y1", "y2"))
    )


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], cell: float = 256.0) -> DataFrame:
    """Pairs of touching boxes; columns of ``a`` get ``a_``, of ``b`` ``b_``.

    Both sides meet only in shared picture cells, and a pair is emitted in the
    one cell that holds the corner where the overlap begins.
    """
    side = lambda df, p: df.select(*on, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in on])
    pairs = _cells(side(a, "a"), cell, "a_").join(_cells(side(b, "b"), cell, "b_"), [*on, "_cx", "_cy"])
    return pairs.where(
        (F.floor(F.greatest("a_x1", "b_x1") / cell) == F.col("_cx"))
        & (F.floor(F.greatest("a_y1", "b_y1") / cell) == F.col("_cy"))
    ).drop("_cx", "_cy")


def pairwise_overlap(dets: DataFrame, threshold: float = 0.30, on=("video_id", "frame")) -> DataFrame:
    """Pairs of detections of a frame with IoU at or above ``threshold`` (> 0)."""
    pairs = overlap_join(dets, dets, list(on)).where("a_det_id < b_det_id")
    return (
        pairs.withColumn("iou", iou(Box.of("a_"), Box.of("b_")))
        .where(F.col("iou") >= threshold)
        .select(*on, "a_det_id", "b_det_id", "iou")
    )


def isolated(dets: DataFrame, threshold: float = 0.30, on=("video_id", "frame")) -> DataFrame:
    """Detections without a partner at or above ``threshold``."""
    pairs = pairwise_overlap(dets, threshold, on)
    touched = pairs.select(*on, F.explode(F.array("a_det_id", "b_det_id")).alias("det_id"))
    return dets.join(touched, [*on, "det_id"], "left_anti")


def crossing_iou(dets: DataFrame, on=("video_id", "frame")) -> DataFrame:
    """Largest overlap of any two detections per frame."""
    worst = pairwise_overlap(dets, 1e-12, on).groupBy(*on).agg(F.max("iou").alias("_m"))
    frames = dets.select(*on).distinct()
    return frames.join(worst, list(on), "left").select(
        *on, F.coalesce("_m", F.lit(0.0)).alias("crossing_iou")
    )


def strip_clear(dets: DataFrame, cover: float = 0.15, on=("video_id", "frame")) -> DataFrame:
    """Detections whose leg strip no other box covers by more than ``cover``."""
    strip = leg_strip(Box.of())
    strips = dets.select(*on, "det_id", *strip.named())
    hits = overlap_join(strips, dets, list(on)).where("a_det_id <> b_det_id")
    covered = hits.where(strip_cover(Box.of("a_"), Box.of("b_")) > cover)
    return dets.join(covered.select(*on, F.col("a_det_id").alias("det_id")), [*on, "det_id"], "left_anti")


def iou_candidates(
    predicted: DataFrame, dets: DataFrame, gate: float = 0.10, weight: float = 0.35,
    on=("video_id", "frame"),
) -> DataFrame:
    """Predicted track boxes with the detections they overlap, and the match cost.

    ``dets`` may carry ``isolated`` and ``sim``; similarity counts only for
    isolated detections.
    """
    pairs = overlap_join(predicted, dets, list(on)).withColumn("iou", iou(Box.of("a_"), Box.of("b_")))
    tie = F.lit(0.0)
    if "b_sim" in pairs.columns:
        tie = F.when(F.col("b_isolated"), weight * F.coalesce("b_sim", F.lit(0.0))).otherwise(0.0)
    return pairs.where(F.col("iou") >= gate).withColumn("cost", -(F.col("iou") + tie))


def nms(dets: DataFrame, threshold: float = 0.55, on=("video_id", "frame")) -> DataFrame:
    """Greedy non-maximum suppression per frame, best score first."""
    box = F.struct(
        (-F.col("score")).alias("s"), "det_id", *[F.col(c).cast("double").alias(c) for c in CORNERS]
    )
    grouped = dets.groupBy(*on).agg(F.sort_array(F.collect_list(box)).alias("_all"))
    as_box = lambda c: Box(*[c[n] for n in CORNERS])

    def step(kept: Column, d: Column) -> Column:
        clash = F.exists(kept, lambda k: iou_floored(as_box(d), as_box(k)) >= threshold)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(d)))

    kept = grouped.select(
        *on, F.explode(F.aggregate("_all", F.slice("_all", 1, 0), step)).alias("k")
    )
    return kept.select(*on, "k.det_id", *[F.col(f"k.{c}") for c in CORNERS], (-F.col("k.s")).alias("score"))


# --- similarity and assignment -----------------------------------------------


#: Vectors and gallery views that one task holds at most, and rows of the strip of cosines it looks at.
TILE, STRIP = 8192, 512


def _pieces(df: DataFrame, by: list[str], weight: Column, least: int, out: str) -> DataFrame:
    """Per key the number of pieces of about ``TILE`` that its rows make, ``least`` at least."""
    return df.groupBy(*by).agg(F.greatest(F.lit(least), F.ceil(F.sum(weight) / TILE)).cast("int").alias(out))


def _met(df: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of the row of ``sizes`` of its key; null is a key."""
    if not by:
        return df.crossJoin(F.broadcast(sizes))
    told = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in sizes.columns if c not in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return df.join(told, same).drop(*[f"_by_{c}" for c in by])


def _top(q: np.ndarray, views: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest products of every row of ``q``, strip by strip."""
    out = np.empty((len(q), min(k, len(views))))
    for at in range(0, len(q), STRIP):
        sims = q[at : at + STRIP] @ views.T
        out[at : at + STRIP] = np.partition(sims, sims.shape[1] - out.shape[1], axis=1)[:, sims.shape[1] - out.shape[1] :]
    return out


def similarity_join(
    vectors: DataFrame, galleries: DataFrame, by: list[str] | None = None,
    k: int = 5, tiles: int = 1, parts: int = 64,
) -> DataFrame:
    """Best and second-best track of every vector by mean of the top ``k`` cosines.

    ``vectors``: (by..., vec_id, embedding); ``galleries``: (by..., track_id,
    gallery), a track in one row or several. Vectors are cut into parts and
    gallery rows into tiles, ``parts`` and ``tiles`` at least and more for keys
    beyond ``TILE`` rows or views each; a task multiplies one part with one tile
    strip by strip and keeps the best ``k`` cosines of each track, which are
    merged over the tiles.
    """
    by = by or []
    views = F.coalesce(F.greatest(F.size("gallery"), F.lit(1)), F.lit(1))
    cuts = _pieces(vectors, by, F.lit(1), parts, "_parts")
    cuts = _met(cuts, _pieces(galleries, by, views, tiles, "_tiles"), by)
    v = _met(vectors.select(*by, "vec_id", "embedding"), cuts, by).withColumn(
        "_part", F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("int")
    ).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).drop("_parts", "_tiles")
    g = _met(galleries.select(*by, "track_id", "gallery"), cuts, by).withColumn(
        "_tile", F.pmod(F.xxhash64("track_id", "gallery"), F.col("_tiles")).cast("int")
    ).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_tiles")
    keys = [*by, "_part", "_tile"]
    schema = T.StructType(
        [
            *[vectors.schema[c] for c in by],
            vectors.schema["vec_id"],
            T.StructField("track_id", galleries.schema["track_id"].dataType),
            T.StructField("top", T.ArrayType(T.DoubleType())),
        ]
    )

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=m.copy(), where=n > 1e-9)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        one_blas_thread()
        q = unit(np.asarray(left["embedding"].tolist(), dtype=float))
        grid = {}
        for track, gallery in zip(right["track_id"], right["gallery"]):
            grid.setdefault(track, []).append(unit(np.asarray(list(gallery), dtype=float)))
        parts = []
        for track, blocks in grid.items():
            part = left[[*by, "vec_id"]].reset_index(drop=True)
            part["track_id"], part["top"] = track, list(_top(q, np.vstack(blocks), k))
            parts.append(part)
        return pd.concat(parts, ignore_index=True)[[f.name for f in schema]]

    v, g = for_python(v, *keys), for_python(g, *keys)
    scored = v.groupBy(*keys).cogroup(g.groupBy(*keys)).applyInPandas(score, schema)
    best = F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, k)
    scored = scored.groupBy(*by, "vec_id", "track_id").agg(best.alias("_best"))
    mean = F.aggregate("_best", F.lit(0.0), lambda a, x: a + x) / F.size("_best")
    scored = scored.withColumn("similarity", mean)
    ranked = scored.groupBy(*by, "vec_id").agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("similarity")).alias("s"), "track_id"))
        ).alias("_r")
    )
    return ranked.select(
        *by,
        "vec_id",
        F.get("_r", F.lit(0))["track_id"].alias("track_id"),
        (-F.get("_r", F.lit(0))["s"]).alias("similarity"),
        (F.get("_r", F.lit(1))["s"] - F.get("_r", F.lit(0))["s"]).alias("margin"),
    )


def gallery_scores(
    vectors: DataFrame, galleries: DataFrame, by: str,
    products: Callable[[np.ndarray, np.ndarray], np.ndarray], exact: Callable[[Column, Column], Column],
) -> DataFrame:
    """(vec_id, best): scores of every vector against the galleries of its key, rows to be merged by vec_id.

    ``vectors``: (by, vec_id, vec); ``galleries``: (by, part, gallery). Vectors
    and views of one width and of finite numbers meet as matrices of at most
    about ``TILE`` rows and views, for which ``products`` gives the scores of
    each row. All others, on either side, meet by ``exact`` over columns.
    """
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 0

    def plain(v: Column) -> Column:
        odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return F.coalesce((F.size(v) == width) & (F.size(v) > 0) & ~odd, F.lit(False))

    told = vectors.select(by, "vec_id", F.col("vec").cast("array<double>").alias("vec"), plain(F.col("vec")).alias("_plain"))
    held = galleries.select(by, "part", "gallery")
    regular = held.withColumn("gallery", F.filter("gallery", plain)).where(F.size("gallery") > 0)
    other = held.withColumn("gallery", F.filter("gallery", lambda g: ~plain(g))).where(F.size("gallery") > 0)
    cuts = _pieces(told.where("_plain"), [by], F.lit(1), 1, "_parts")
    cuts = cuts.join(_pieces(regular, [by], F.size("gallery"), 1, "_tiles"), by)
    v = told.where("_plain").join(cuts, by).withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("int"))
    v = v.select(F.col(by).alias("_of"), "vec_id", "vec", "_part", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_tile"))
    g = regular.join(cuts, by).withColumn("_tile", F.pmod("part", F.col("_tiles")).cast("int"))
    g = g.select(F.col(by).alias("_of"), "gallery", "_tile", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    keys = ["_of", "_part", "_tile"]
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("best", T.ArrayType(T.DoubleType()))])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        one_blas_thread()
        views = np.vstack([np.asarray(list(rows), dtype=float) for rows in right["gallery"]])
        best = products(np.asarray(left["vec"].tolist(), dtype=float), views)
        return pd.DataFrame({"vec_id": left["vec_id"].to_numpy(), "best": list(best)})

    v, g = for_python(v, *keys), for_python(g, *keys)
    matched = v.groupBy(*keys).cogroup(g.groupBy(*keys)).applyInPandas(score, schema)
    rest = told.where("NOT _plain").join(held, by).unionByName(told.where("_plain").join(other, by))
    return matched.unionByName(rest.select("vec_id", exact(F.col("vec"), F.col("gallery")).alias("best")))


def best_products(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The ``k`` best dot products of every row with the views, as ``gallery_best`` has them."""
    return lambda q, views: np.sort(_top(q, views, k), axis=1)[:, ::-1]


def best_histogram(q: np.ndarray, views: np.ndarray) -> np.ndarray:
    """The largest ``hist_similarity`` of every row with the views, in one column."""

    def shares(h: np.ndarray) -> np.ndarray:
        mass = h.sum(axis=1, keepdims=True)
        return h / np.where(mass > 1e-12, mass, 1.0)

    q, views = shares(q), shares(views)
    n = q.shape[1]
    out = np.full((len(q), 1), -np.inf)
    spread = lambda p: (p * p).sum(axis=1) - p.sum(axis=1) ** 2 / n
    for i in range(0, len(q), STRIP):
        a = q[i : i + STRIP]
        for j in range(0, len(views), STRIP):
            b = views[j : j + STRIP]
            mass = a.sum(axis=1)[:, None] * b.sum(axis=1)[None, :]
            scale = 1.0 / np.sqrt(np.where(mass > 0, mass, 1.0))
            bhatta = np.sqrt(np.maximum(0.0, 1.0 - scale * (np.sqrt(a) @ np.sqrt(b).T)))
            denom = np.sqrt(np.maximum(spread(a)[:, None] * spread(b)[None, :], 0.0))
            wide = denom > 2.3e-16
            corr = np.where(wide, (a @ b.T - mass / n) / np.where(wide, denom, 1.0), 1.0)
            common, low = np.zeros_like(mass), np.empty_like(mass)
            for x, y in zip(a.T, b.T, strict=True):
                np.minimum(x[:, None], y[None, :], out=low)
                common += low
            parts = (0.40, 1.0 - bhatta), (0.35, (corr + 1.0) * 0.5), (0.25, common)
            total = sum(w * np.clip(x, 0.0, 1.0) for w, x in parts)
            out[i : i + STRIP, 0] = np.maximum(out[i : i + STRIP, 0], total.max(axis=1))
    return out


def match_level(similarity: Column, margin: Column) -> Column:
    """Which re-identification rule a best match passes, if any."""
    clear = F.coalesce(margin, F.lit(1.0)) >= 0.03
    return (
        F.when(similarity >= 0.84, "strict")
        .when((similarity >= 0.76) & clear, "recent")
        .when((similarity >= 0.60) & clear, "floor")
    )


def cheapest_pairs(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a minimum-cost one-to-one assignment.

    Shortest augmenting paths with dual prices, one row at a time.
    """
    cost = np.asarray(cost, dtype=float)
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of, col_of = np.full(m, -1), np.full(n, -1)
    for start in range(n):
        reach = np.full(m, np.inf)
        came_from = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        base, row = 0.0, start
        visited = []
        while True:
            visited.append((row, base))
            trial = base + c[row] - row_price[row] - col_price
            closer = ~done & (trial < reach)
            reach[closer] = trial[closer]
            came_from[closer] = row
            col = int(np.argmin(np.where(done, np.inf, reach)))
            base = float(reach[col])
            done[col] = True
            if row_of[col] < 0:
                break
            row = int(row_of[col])
        for r, at in visited:
            row_price[r] += base - at
        col_price[done] -= base - reach[done]
        while True:
            r = int(came_from[col])
            row_of[col] = r
            col_of[r], col = col, int(col_of[r])
            if r == start:
                break
    cols = np.flatnonzero(row_of >= 0)
    rows = row_of[cols]
    if flipped:
        rows, cols = cols, rows
    order = np.argsort(rows)
    return rows[order], cols[order]


def assign_one_to_one(
    costs: DataFrame, by: list[str], row: str, col: str, cost: str = "cost", gate: float = 1e5
) -> DataFrame:
    """Optimal one-to-one pairs per group; missing pairs cost 1e6 and never match.

    A group is what one frame or segment offers; many groups share one Arrow batch.
    """
    rtype, ctype = costs.schema[row].dataType, costs.schema[col].dataType
    pair = T.StructType(
        [T.StructField(row, rtype), T.StructField(col, ctype), T.StructField(cost, T.DoubleType())]
    )

    @F.pandas_udf(T.ArrayType(pair))
    def solve(rows: pd.Series, cols: pd.Series, vals: pd.Series) -> pd.Series:
        out = []
        for rr, cc, vv in zip(rows, cols, vals):
            if len(set(rr)) == len(rr) and len(set(cc)) == len(cc):  # nothing to contest
                out.append(
                    [
                        {row: a.item(), col: b.item(), cost: float(v)}
                        for a, b, v in zip(rr, cc, vv)
                        if v < gate
                    ]
                )
                continue
            r_ids, r_at = np.unique(rr, return_inverse=True)
            c_ids, c_at = np.unique(cc, return_inverse=True)
            grid = np.full((len(r_ids), len(c_ids)), 1e6)
            grid[r_at, c_at] = vv
            i, j = cheapest_pairs(grid)
            out.append(
                [
                    {row: r_ids[a].item(), col: c_ids[b].item(), cost: float(grid[a, b])}
                    for a, b in zip(i, j)
                    if grid[a, b] < gate
                ]
            )
        return pd.Series(out)

    grouped = costs.groupBy(*by).agg(
        F.collect_list(row).alias("_r"), F.collect_list(col).alias("_c"), F.collect_list(cost).alias("_v")
    )
    grouped = for_python(grouped, *by)
    solved = grouped.select(*by, F.explode(solve("_r", "_c", "_v")).alias("_p"))
    return solved.select(*by, f"_p.{row}", f"_p.{col}", f"_p.{cost}")


# --- intervals and as-of -----------------------------------------------------


def interval_join(
    points: DataFrame, ranges: DataFrame, on: list[str], at: str = "t", bucket: float = 64.0,
    how: str = "inner",
) -> DataFrame:
    """Points with the ranges ``[start_sec, end_sec)`` that contain them.

    A range without end is open and reaches to the last point of its key. Ranges
    are cut at bucket borders so that the join is an equi-join on the bucket; a
    point lies in one bucket, so no pair comes twice.
    """
    last = points.groupBy(*on).agg((F.max(at) + bucket).alias("_last"))
    closed = ranges.join(last, list(on), "left").withColumn("_end", F.coalesce("end_sec", "_last")).drop("_last")
    cut_ranges = closed.where(F.col("_end") > F.col("start_sec")).withColumn(
        "_bkt",
        F.explode(F.sequence(F.floor(F.col("start_sec") / bucket), F.floor(F.col("_end") / bucket))),
    )
    keyed = points.withColumn("_bkt", F.floor(F.col(at) / bucket))
    p, q = keyed.alias("p"), cut_ranges.alias("q")
    cond = F.lit(True)
    for k in [*on, "_bkt"]:
        cond = cond & (F.col(f"p.{k}") == F.col(f"q.{k}"))
    cond = cond & (F.col(f"p.{at}") >= F.col("q.start_sec")) & (F.col(f"p.{at}") < F.col("q._end"))
    joined = p.join(q, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bkt")
    extra = [F.col(f"q.{c}") for c in ranges.columns if c not in points.columns]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *extra)


def asof(
    points: DataFrame, facts: DataFrame, on: list[str], at: str, fact_at: str,
    payload: list[str], block: int = DEFAULT_BLOCK_ROWS, forward: bool = False, strict: bool = False,
) -> DataFrame:
    """Points with the payload of the latest fact at or before them.

    A fact whose payload is null still counts: the latest record wins.
    ``forward`` also adds the earliest fact after, as ``after``; the payload
    structs hold the fact's own position as ``at``. ``strict`` means before.
    """
    fact = F.struct(F.col(fact_at).alias("at"), *[F.col(c) for c in payload])
    f = facts.select(
        *on, F.col(fact_at).cast("double").alias("_t"), F.lit(1 if strict else 0).alias("_o"), fact.alias("_fact")
    )
    row = F.struct(*[F.col(c) for c in points.columns])
    p = points.select(
        *on, F.col(at).cast("double").alias("_t"), F.lit(0 if strict else 1).alias("_o"), row.alias("_row")
    )
    line = Line(tuple(on), "_t", block, ("_o",))
    scans = {"before": ("last", F.col("_fact"))}
    if forward:
        scans["after"] = ("next", F.col("_fact"))
    out = running(p.unionByName(f, allowMissingColumns=True), line, **scans)
    extra = ["after"] if forward else []
    return out.where(F.col("_row").isNotNull()).select("_row.*", "before", *extra)


def asof_hold(frames: DataFrame, boxes: DataFrame, on=("run_id",), at: str = "frame_index") -> DataFrame:
    """Box of the latest record at or before each frame, null if that has none."""
    out = asof(frames, boxes, list(on), at, "video_frame", ["bbox"])
    return out.withColumn("bbox", F.col("before.bbox")).drop("before")


def asof_nearest(times: DataFrame, frames: DataFrame, on=("run_id",), at: str = "target") -> DataFrame:
    """Nearest frame of a time and the fractional cursor between its neighbours."""
    out = asof(times, frames, list(on), at, "video_frame", ["frame_index"], forward=True, strict=True)
    b, a, t = F.col("before"), F.col("after"), F.col(at)
    prev_gap, next_gap = F.abs(b["at"] - t), F.abs(a["at"] - t)
    nearest = (
        F.when(a.isNull(), b["frame_index"])
        .when(b.isNull(), a["frame_index"])
        .when(prev_gap <= next_gap, b["frame_index"])
        .otherwise(a["frame_index"])
    )
    span = F.greatest(F.lit(1e-6), a["at"] - b["at"])
    share = F.least(F.greatest((t - b["at"]) / span, F.lit(0.0)), F.lit(1.0))
    cursor = (
        F.when(b.isNull(), F.lit(0.0))
        .when(a.isNull(), b["frame_index"].cast("double"))
        .otherwise(b["frame_index"] + share)
    )
    return out.withColumns({"nearest": nearest, "cursor": cursor}).drop("before", "after")


def nearest_present(df: DataFrame, has: str, radius: int = 12, line: Line = RUNS) -> DataFrame:
    """Nearest row with data within ``radius``, the earlier on a tie; null if absent."""
    pos = F.col(line.pos)
    at = F.when(F.col(has), pos)

    def exprs(w):
        return {
            "_b": F.last(at, ignorenulls=True).over(w.rowsBetween(-radius, 0)),
            "_a": F.first(at, ignorenulls=True).over(w.rowsBetween(0, radius)),
        }

    out = neighbourhood(df, line, radius, exprs)
    b, a = F.col("_b"), F.col("_a")
    near = F.when(a.isNull() | (pos - b <= a - pos), b).otherwise(F.coalesce(a, b))
    present = F.col("present") if "present" in df.columns else F.lit(True)
    return out.withColumn("nearest", F.when(present, near)).drop("_b", "_a")


# --- joins over runs, tracks and prompts ---------------------------------------


#: Tracks of subjects that are broadcast at most.
MOST_WANTED = 100_000


def select_subject_tracks(dets: DataFrame, subjects: DataFrame, width: float, height: float) -> DataFrame:
    """Best detection per subject and frame, in whole pixels.

    ``subjects``: subject_id, track_ids. The highest score wins, the first
    detection of the frame on a tie.
    """
    wanted = cut(subjects.select("subject_id", F.explode("track_ids").alias("track_id")))
    if wanted.limit(MOST_WANTED + 1).count() <= MOST_WANTED:
        wanted = F.broadcast(wanted)  # few tracks would each be one task's
    best = (
        dets.join(wanted, "track_id")
        .groupBy("subject_id", "video_id", "frame")
        .agg(
            F.min(F.struct((-F.col("score")).alias("s"), "det_id", *CORNERS)).alias("_best")
        )
    )
    b = lambda c: round_half_up(F.col(f"_best.{c}"))
    return best.select(
        "subject_id", "video_id", "frame", *[b(c).alias(c) for c in CORNERS], (-F.col("_best.s")).alias("score")
    )


def sibling_runs(runs: DataFrame, primaries: DataFrame) -> DataFrame:
    """Other runs made from the track file of each asked run.

    ``primaries``: run_id, track_file of the runs asked for. The output grows
    with the answers; asking for one run per file keeps it linear in the runs.
    """
    asked = primaries.select("run_id", "track_file").where(F.col("track_file").isNotNull())
    others = runs.select(F.col("run_id").alias("sibling_id"), "track_file")
    return asked.join(others, "track_file").where("run_id <> sibling_id")


def finished_runs(runs: DataFrame, active: DataFrame) -> DataFrame:
    return runs.join(active, "run_id", "left_anti")


def align_siblings(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every primary frame with the sibling frame shown beside it.

    ``frames``: run_id, frame_index; ``pairs``: run_id, sibling_id. A sibling
    that ended holds its last frame.
    """
    sizes = frames.groupBy("run_id").agg((F.max("frame_index") + 1).alias("_n"))
    pairs = pairs.join(sizes.withColumnRenamed("run_id", "sibling_id"), "sibling_id")
    return frames.select("run_id", "frame_index").join(pairs, "run_id").select(
        "run_id",
        "frame_index",
        "sibling_id",
        F.least(F.col("frame_index"), F.col("_n") - 1).alias("sibling_frame"),
    )


def primary_anchor(anchors: DataFrame, keys: list[str], order: str = "frame_index") -> DataFrame:
    """The anchor at the upper median position of each key."""
    at = exact_quantiles(anchors.withColumn("_p", F.col(order).cast("double")), keys, "_p", {"_mid": 0.5}, floor_rank=True)
    return anchors.join(at, keys).where(F.col(order) == F.col("_mid")).drop("_mid")


def toe_off_in_stride(strides: DataFrame, events: DataFrame, line: Line = RUNS) -> DataFrame:
    """First toe-off strictly inside each stride of the same side, if any."""
    keys = [*line.keys, "side"]
    offs = events.where(F.col("type") == "toe_off")
    out = asof_next(strides, offs, keys, "start_frame", line.pos)
    return out.withColumn(
        "toe_off", F.when(F.col("_next") < F.col("end_frame"), F.col("_next"))
    ).drop("_next")


def asof_next(points: DataFrame, facts: DataFrame, on: list[str], at: str, fact_at: str) -> DataFrame:
    """Points with the position of the first fact strictly after them."""
    row = F.struct(*[F.col(c) for c in points.columns])
    p = points.select(*on, F.col(at).alias("_t"), F.lit(1).alias("_o"), row.alias("_row"))
    f = facts.select(*on, F.col(fact_at).alias("_t"), F.lit(0).alias("_o"))
    both = p.unionByName(f, allowMissingColumns=True)
    out = running(
        both, Line(tuple(on), "_t", DEFAULT_BLOCK_ROWS, ("_o",)),
        _next=("after", F.when(F.col("_o") == 0, F.col("_t"))),
    )
    return out.where(F.col("_row").isNotNull()).select("_row.*", "_next")


def fallback_match(hits: DataFrame, prompts: DataFrame) -> DataFrame:
    """Detections of the first variant with hits per prompt, else the generic ones.

    ``hits``: frame_id, variant, det_id; ``prompts``: prompt, variants. A frame
    without a generic hit yields nothing.
    """
    person = hits.where(F.lower("variant") == "person")
    gated = hits.join(person.select("frame_id").distinct(), "frame_id", "left_semi")
    ranked = prompts.select("prompt", F.posexplode("variants").alias("rank", "variant")).where(
        F.lower("variant") != "person"
    )
    tried = gated.join(ranked, "variant")
    first = tried.groupBy("frame_id", "prompt").agg(F.min("rank").alias("rank"))
    specific = tried.join(first, ["frame_id", "prompt", "rank"]).select(
        "frame_id",
        "det_id",
        F.concat(
            F.when(F.lower("variant") == F.lower(F.trim("prompt")), "prompt:").otherwise("prompt_fallback:"),
            F.col("variant"),
        ).alias("source"),
    )
    named = prompts.agg(F.max(F.lower(F.trim("prompt")) == "person").alias("_named"))
    generic = person.join(specific.select("frame_id").distinct(), "frame_id", "left_anti")
    generic = generic.crossJoin(F.broadcast(named)).select(
        "frame_id",
        "det_id",
        F.when(F.col("_named"), "prompt:person").otherwise("prompt_fallback:person").alias("source"),
    )
    return specific.unionByName(generic)


def carry_resolution(records: DataFrame, resolved: DataFrame, floor: float, line: Line = RUNS) -> DataFrame:
    """Hold each resolved state until the next one and suppress bystander frames.

    ``records``: run_id, frame_index, present, gallery; ``resolved``: run_id,
    frame_index, state, confidence, ambiguous. A present record is suppressed
    where the state is absent, unless its similarity reaches ``floor``; nothing
    is ever brought back.
    """
    payload = ["state", "confidence", "ambiguous"]
    out = asof(records, resolved, list(line.keys), line.pos, line.pos, payload, line.block)
    state = F.coalesce(F.col("before.state"), F.lit("unknown"))
    weak = F.col("gallery").isNull() | (F.col("gallery") < floor)
    out = out.withColumn("suppressed", F.col("present") & (state == "absent") & weak)
    return out.withColumns(
        {
            "identity_confidence": F.when(F.col("present"), F.col("before.confidence")),
            "identity_ambiguous": F.col("present") & F.coalesce(F.col("before.ambiguous"), F.lit(False)),
            "subject_present": F.col("present") & ~F.col("suppressed"),
            "tracking_status": F.when(F.col("suppressed"), "distractor_suppressed")
            .when(F.col("present"), "tracked")
            .otherwise("subject_lost"),
        }
    ).drop("before")
