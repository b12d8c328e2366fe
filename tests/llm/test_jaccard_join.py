import random

import numpy as np
import pytest
from edges import LONG, edge_docs, no_docs
from pyspark.sql import functions as F

from stridegrid.llm import jaccard_join
from stridegrid.llm.common import staged
from stridegrid.llm.jaccard_join import PrefixTree, jaccard_components, needed, prefix_size, shingles


def sets_of(text, words=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words=5, percent=75):
    sets = [sets_of(t, words) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [k for j, (k, _) in enumerate(rows) if root(j) == root(i) and k is not None]
        out.append((key, len(sets[i]), min(keys) if sets[i] and keys else key))
    return sorted(out, key=str)


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 6, 20, 60)))] for _ in range(12)]
    line = [rng.choice(vocabulary) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 6))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if i % 3 == 0:
            w += line
        rows.append((i + 1, rng.choice((" ", "\n", "\t ")).join(w)))
    return rows


@pytest.mark.parametrize("tight", [False, True])
def test_matches_brute_force(spark, monkeypatch, tight):
    rows = [*corpus(), (900, None), (901, ""), (902, " \n"), (None, "a b c d e f"), (None, "a b c d e f"), (903, "A b c d e F")]
    if tight:  # several blocks, salted tokens, runs across batches
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
        monkeypatch.setattr(jaccard_join, "SALTS", 3)
        monkeypatch.setattr(jaccard_join, "_levels", lambda rows: (np.full(1 << 22, 200, np.uint8), 0.0, 1.0))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        got = sorted(map(tuple, jaccard_components(docs).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_edges(spark):
    got = jaccard_components(edge_docs(spark)).collect()
    want = brute([(r.doc_id, r.text) for r in edge_docs(spark).select("doc_id", "text").collect()])
    assert sorted(map(tuple, got), key=str) == want
    assert {r.doc_id: r.component_id for r in got}[6] == 5 and len(sets_of(LONG)) > 5000
    assert jaccard_components(no_docs(spark)).count() == 0


def test_tree_finds_what_comparing_finds():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25))) for _ in range(60)] + [np.arange(12)] * 2
    tree = PrefixTree(sets)
    for x in sets:
        flags = np.zeros(31, np.int64)
        flags[x] = 1
        got = {tree.order[p] for p in tree.links(x, flags, np.arange(len(sets)), 75, lambda p: False)}
        want = {
            i for i, y in enumerate(sets)
            if 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
        }
        assert got == want


def test_bounds():
    assert prefix_size(4, 75) == 2 and prefix_size(1, 75) == 1
    assert needed(4, 4, 75) == 4 and needed(7, 7, 75) == 6
    assert len(shingles("a b c")) == 1 and len(shingles("A b C d e f")) == 2 and len(shingles("\x1c")) == 1


def test_a_set_goes_only_where_it_meets_another(spark):
    # blocks 1 and 2 share token 7 by sets 11 and 21 alone; set 13 shares no token within its block
    placed = spark.createDataFrame(
        [(7, 11, 1), (7, 21, 2), (8, 11, 1), (8, 12, 1), (9, 13, 1), (9, 31, 3), (6, 21, 2), (6, 22, 2)],
        "token bigint, sid bigint, block bigint",
    )
    in_block = placed.groupBy("token", "block").agg(F.expr("min(sid) < max(sid)").alias("several"))
    got = sorted(map(tuple, jaccard_join._places(placed, in_block).collect()))
    assert got == [
        (11, 1, 1, 0), (11, 1, 2, 0), (12, 1, 1, 0), (13, 1, 3, 0), (21, 1, 2, 1), (21, 2, 2, 0), (22, 2, 2, 0), (31, 1, 3, 1),
    ]


def test_shuffles_of_a_step_go_when_it_is_written(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    held = shuffles()
    kept = staged(spark.range(1000).repartition(7, "id"), "dealt")
    assert kept.count() == 1000 and spark.conf.get(key) == before
    assert shuffles() <= held + 1  # the count's own, at most


def test_levels_take_little_more_than_the_sketch(spark):
    import tracemalloc

    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string").repartition(3)
    docs = docs.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"), F.xxhash64("text").alias("_tid"))
    rows = jaccard_join._set_rows(docs, 5).where("chunk IS NOT NULL").localCheckpoint()
    tracemalloc.start()
    try:
        known, mean, scale = jaccard_join._levels(rows)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    count = np.zeros(1 << jaccard_join.SKETCH_BITS)
    for _, text in corpus():
        np.add.at(count, jaccard_join._bucket(shingles(text)), 1)
    assert (known == np.floor(scale * np.log2(count + 1))).all() and mean == count.mean()
    assert most < 64e6  # counts are 34 MB
