"""Similarity of embedding vectors and appearance histograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stridegrid.functions.numbers import clip, let


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2norm(a: Column) -> Column:
    return let(
        length(a),
        lambda n: F.transform(
            a, lambda x: x.cast("double") / F.when(n > 1e-9, n).otherwise(1.0)
        ),
    )


def cosine01(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]; null for unequal sizes or zero vectors."""

    def score(n: Column) -> Column:
        usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (n["a"] > 1e-12) & (n["b"] > 1e-12)
        return F.when(usable, clip((dot(a, b) / (n["a"] * n["b"]) + 1.0) * 0.5, 0.0, 1.0))

    return let(F.struct(length(a).alias("a"), length(b).alias("b")), score)


def l1_normalize(h: Column) -> Column:
    return let(
        total(h),
        lambda m: F.transform(
            h, lambda x: x.cast("double") / F.when(m > 1e-12, m).otherwise(1.0)
        ),
    )


def hist_similarity(a: Column, b: Column) -> Column:
    """Blend of Bhattacharyya, correlation and intersection similarity, 0..1."""
    pairs = F.zip_with(
        l1_normalize(a), l1_normalize(b), lambda x, y: F.struct(x.alias("p"), y.alias("q"))
    )
    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(n) for n in ("p", "q", "pp", "qq", "pq", "root", "low")])

    def add(s: Column, v: Column) -> Column:
        p, q = v["p"], v["q"]
        return F.struct(
            (s["p"] + p).alias("p"),
            (s["q"] + q).alias("q"),
            (s["pp"] + p * p).alias("pp"),
            (s["qq"] + q * q).alias("qq"),
            (s["pq"] + p * q).alias("pq"),
            (s["root"] + F.sqrt(p * q)).alias("root"),
            (s["low"] + F.least(p, q)).alias("low"),
        )

    def score(s: Column) -> Column:
        n = F.size(a).cast("double")
        mass = s["p"] * s["q"]
        scale = F.when(mass > 0, 1.0 / F.sqrt(mass)).otherwise(1.0)
        bhatta = F.sqrt(F.greatest(zero, 1.0 - scale * s["root"]))
        cov = s["pq"] - mass / n
        spread = (s["pp"] - s["p"] * s["p"] / n) * (s["qq"] - s["q"] * s["q"] / n)
        denom = F.sqrt(F.greatest(spread, zero))
        corr = F.when(denom > 2.3e-16, cov / denom).otherwise(1.0)
        return (
            0.40 * clip(1.0 - bhatta, 0.0, 1.0)
            + 0.35 * clip((corr + 1.0) * 0.5, 0.0, 1.0)
            + 0.25 * clip(s["low"], 0.0, 1.0)
        )

    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, start, add, score))


def gallery_best(vec: Column, gallery: Column, k: int = 5) -> Column:
    """The ``k`` best dot products against a gallery, best first."""
    return let(
        vec,
        lambda v: F.slice(F.sort_array(F.transform(gallery, lambda g: dot(g, v)), False), 1, k),
    )


def gallery_topk(vec: Column, gallery: Column, k: int = 5) -> Column:
    """Mean of the ``k`` best dot products against a gallery; 0 when empty."""
    mean = let(gallery_best(vec, gallery, k), lambda s: total(s) / F.size(s))
    return F.when(F.coalesce(F.size(gallery), F.lit(0)) > 0, mean).otherwise(0.0)


def gallery_max(hist: Column, gallery: Column) -> Column:
    best = let(
        hist, lambda h: F.array_max(F.transform(gallery, lambda g: hist_similarity(g, h)))
    )
    return F.when(F.size(gallery) > 0, best)


def mean_abs_diff(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return total(gaps) / F.size(a)
