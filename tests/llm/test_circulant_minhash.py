import numpy as np
import pytest
from edges import LONG, edge_docs, no_docs
from test_jaccard_join import brute, corpus, sets_of

from stridegrid.llm import circulant_minhash, jaccard_join
from stridegrid.llm.circulant_minhash import PLACE_BITS, _permutations, bucket_links, minhash_components, signature
from stridegrid.llm.jaccard_join import shingles


def answer(rows):
    return sorted([(k, n, c, k == c) for k, n, c in brute(rows, words=2, percent=80)], key=str)


@pytest.mark.parametrize("tight", [False, True])
def test_matches_brute_force(spark, monkeypatch, tight):
    rows = [*corpus(seed=3), (900, None), (901, ""), (902, " \n"), (None, "a b c"), (None, "a b c"), (903, "A b C")]
    if tight:  # many small blocks and batches: all three rounds, salted buckets, buckets across batches
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
        monkeypatch.setattr(circulant_minhash, "SALTS", 3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        got = sorted(map(tuple, minhash_components(docs).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == answer(rows)


def test_edges(spark):
    got = minhash_components(edge_docs(spark)).collect()
    rows = [(r.doc_id, r.text) for r in edge_docs(spark).select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == answer(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[5] and not kept[6] and kept[None] and len(sets_of(LONG, 2)) > 5000
    assert minhash_components(no_docs(spark)).count() == 0


def test_signature_is_the_minimum_over_shifted_permutations():
    found = shingles("the quick brown fox jumps over the lazy dog", 2)
    sigma, around = _permutations(40)
    pi = around[:, 0]
    places = [int(sigma[int(x) >> (64 - PLACE_BITS)]) for x in found]
    want = [min(int(pi[(p + k) % len(pi)]) for p in places) for k in range(40)]
    assert signature(found, 40).tolist() == want
    assert sorted(sigma.tolist()) == sorted(pi.tolist()) == list(range(1 << PLACE_BITS))


def test_share_of_equal_coordinates_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2)
    y = np.unique(np.concatenate((x[:320], rng.integers(0, 2**63, 80).astype(np.uint64) * np.uint64(2))))
    want = 320 / 480
    same = (signature(np.unique(x), 1024) == signature(y, 1024)).mean()
    assert abs(same - want) < 0.06


def test_bucket_links_joins_each_group_once():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 10_000, 40)).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.append(b, np.uint64(20_000 + i))) for b in base for i in range(6)]
    n = len(sets)
    tokens = [np.array([1], np.int64)] * n
    links = bucket_links(np.arange(n), np.zeros(n, int), np.arange(n), tokens, sets, 80)
    assert len(links) == n - 4 and all(a // 6 == b // 6 for a, b in links)
    side = np.arange(n) % 2
    across = bucket_links(np.arange(n), side, np.arange(n), tokens, sets, 80)
    assert all(side[a] != side[b] for a, b in across) and {a // 6 for a, _ in across} == {0, 1, 2, 3}
