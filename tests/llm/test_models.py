import numpy as np
from edges import edge_docs, edge_labels, no_docs, no_labels
from pyspark.sql import functions as F

from stridegrid.llm.common import held_out
from stridegrid.llm.language import ByteNetwork, fit_language, gradients, predict_language
from stridegrid.llm.quality import fit_quality, passages, score_quality
from stridegrid.llm.queries import op1_quality, op8_language, op10_toxicity
from stridegrid.llm.toxicity import fit_ordinal, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op1_quality(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.predicted == got.quality).mean() > 0.9


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op8_language(spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and ((got.score >= 0) & (got.score <= 1)).all()


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op10_toxicity(spark, SF).join(labels.withColumnRenamed("toxic", "label"), "doc_id").where("held_out").toPandas()
    assert ((got.severity >= 0) & (got.severity <= 3)).all()
    clean = got[got.label == 0]
    assert (~clean.toxic).mean() > 0.97
    assert (got.toxic == (got.label == 1)).mean() > 0.93


def test_models_on_edges(spark):
    docs, labels = edge_docs(spark), edge_labels(spark)
    for table in (docs, no_docs(spark)):
        for truth in (labels, no_labels(spark)):
            n = table.count()
            assert score_quality(table, fit_quality(table, truth, F.lit(True))).where("score BETWEEN 0 AND 1").count() == n
            model = fit_toxicity(table, truth, F.lit(True), least_documents=1, least_score=0.0)
            assert score_toxicity(table, model).where("severity BETWEEN 0 AND 3").count() == n
        net = fit_language(table, F.lit(True))
        got = predict_language(table, net).collect()
        assert len(got) == table.count()
        assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 4))
        assert all(r.lang_pred in ("de", "en", "fr") for r in got if r.doc_id in (1, 5, 8, 9))


def test_no_language_at_all(spark):
    docs = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in predict_language(docs, fit_language(docs, F.lit(True))).collect()} == {"und"}


def test_folds(spark):
    import zlib

    got = spark.range(50).withColumn("h", held_out("id", 4, 2)).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_network_gradients():
    rng = np.random.default_rng(0)
    h = 5
    net = ByteNetwork(
        list("abc"), rng.normal(0, 0.3, (2, 3 * h, 256)), rng.normal(0, 0.4, (2, 3 * h, h)), rng.normal(0, 0.4, (3, 2 * h)), np.zeros(3)
    )
    b = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    ok, y = np.arange(7)[:, None] < np.array([7, 5, 7, 1, 6]), np.array([0, 1, 2, 2, 0])
    _, g = gradients(net, b, ok, y)
    for name in ("table", "state", "out", "bias"):
        p = getattr(net, name)
        for i in np.argsort(-np.abs(g[name]).ravel())[:3]:
            old, e = p.flat[i], 1e-3
            p.flat[i] = old + e
            up = gradients(net, b, ok, y)[0]
            p.flat[i] = old - e
            down = gradients(net, b, ok, y)[0]
            p.flat[i] = old
            assert abs((up - down) / (2 * e) - g[name].flat[i]) < 1e-3


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 3))
    grade = np.digitize(x @ [2.0, -1.0, 0.0] + rng.logistic(size=2000), [-1.0, 0.5, 2.0])
    w, theta = fit_ordinal(x, grade, 4)
    assert np.abs(w - [2.0, -1.0, 0.0]).max() < 0.3 and (np.diff(theta) > 0).all()
    assert np.abs(theta - [-1.0, 0.5, 2.0]).max() < 0.3


def test_passages_cover_texts():
    starts, ends = np.array([0, 10, 10, 2000]), np.array([10, 10, 1500, 2513])
    a, b, owner = passages(starts, ends, 512)
    for i in range(4):
        own = owner == i
        assert a[own][0] == starts[i] and b[own][-1] == ends[i] and (a[own][1:] == b[own][:-1]).all()
        assert (b[own] - a[own] <= 512).all()


def test_language_states_of_a_round_stay_in_cache(spark):
    from stridegrid.llm import language

    assert language.LANES * language.SEGMENT * 12 * 4 <= 2 << 20  # one direction of a network of 12 states


def test_language_shares_in_single_precision_are_those_of_both_passes():
    from stridegrid.llm.language import _laid_out

    rng = np.random.default_rng(1)
    net = ByteNetwork(list("abc"), *(rng.normal(0, 0.5, s) for s in ((2, 12, 256), (2, 12, 4), (3, 8))), rng.normal(0, 0.5, 3))
    held = rng.integers(0, 256, 300).astype(np.uint8)
    bytes_, valid = _laid_out(held, np.array([0, 64, 120, 200]), np.array([64, 120, 120, 233]))
    seen = net.states(bytes_, valid, 0), net.states(bytes_, valid, 1)
    want = sum(net.labels(seen, t) * valid[t] for t in range(len(bytes_)))
    got = net.summed(bytes_, valid)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4) and not got[:, 2].any()
    kinds = []
    take = np.take
    try:
        np.take = lambda a, *x, **k: kinds.append(a.dtype) or take(a, *x, **k)
        net.summed(bytes_, valid)
    finally:
        np.take = take
    assert set(kinds) == {np.dtype(np.float32)}
