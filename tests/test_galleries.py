"""Joins with galleries against plain products, over pieces smaller than the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridegrid.functions import vectors as V
from stridegrid.operators import joins as J

SCHEMA = "label bigint, vec_id bigint, embedding array<double>"


def _vectors(spark, rows=90, labels=3):
    at = np.random.default_rng(5).normal(size=(rows, 4))
    return at, spark.createDataFrame([(i % labels, i, list(map(float, v))) for i, v in enumerate(at)], SCHEMA)


def _unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_pieces_of_the_similarity_join_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE", 16)
    at, df = _vectors(spark)
    galleries = J.label_galleries(df, 4).withColumnRenamed("label", "track_id")
    held = {"v": 0}
    grouped = J.for_python

    def watched(rows, *keys):
        counted = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
        held["v"] = max(held["v"], counted)
        return grouped(rows, *keys)

    monkeypatch.setattr(J, "for_python", watched)
    got = {r.vec_id: r for r in J.similarity_join(df, galleries, parts=1).collect()}
    assert held["v"] <= 40  # with one part and one tile it was the table of 90
    sims = _unit(at) @ _unit(at).T
    mean = np.stack([np.sort(sims[:, np.arange(90) % 3 == t], axis=1)[:, -5:].mean(axis=1) for t in range(3)], axis=1)
    assert [got[i].track_id for i in range(90)] == mean.argmax(axis=1).tolist()
    assert [got[i].similarity for i in range(90)] == pytest.approx(mean.max(axis=1).tolist())


@pytest.mark.parametrize("kind", ["topk", "max"])
def test_gallery_scores_meet_in_bounded_pieces(spark, monkeypatch, kind):
    monkeypatch.setattr(J, "TILE", 16)
    monkeypatch.setattr(J, "STRIP", 5)
    at, df = _vectors(spark)
    # a vector without value, one of another width and one with a hole meet as columns
    odd = spark.createDataFrame([(0, 900, None), (0, 901, [1.0, 2.0]), (1, 902, [1.0, None, 2.0, 3.0])], SCHEMA)
    df = df.unionByName(odd)
    mag = lambda c: F.transform(c, lambda x: F.abs(x.cast("double")))
    g = J.label_galleries(df, 4)
    if kind == "topk":
        v = df.withColumn("vec", V.l2norm(F.col("embedding")))
        products, exact = J.best_products(5), V.gallery_best
    else:
        v, g = df.withColumn("vec", mag("embedding")), g.withColumn("gallery", F.transform("gallery", mag))
        products, exact = J.best_histogram, lambda h, g: F.array(V.gallery_max(h, g))
    best = F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, 5 if kind == "topk" else 1)
    merged = lambda rows: {r.vec_id: r.best for r in rows.groupBy("vec_id").agg(best.alias("best")).collect()}
    got = merged(J.gallery_scores(v, g, "label", products, exact))
    want = merged(v.join(g, "label").select("vec_id", exact(F.col("vec"), F.col("gallery")).alias("best")))
    assert got.keys() == want.keys() and len(got) == 93
    for i, scores in want.items():
        assert [x is None for x in got[i]] == [x is None for x in scores]
        assert [x for x in got[i] if x is not None] == pytest.approx([x for x in scores if x is not None], abs=1e-7)
