import random

import numpy as np
import pytest
from edges import edge_docs, no_docs
from pyspark.sql import functions as F

from stridegrid.llm.suffix_repeats import anchors, intervals, merged, remove_repeats, repeat_groups


def brute(rows, length):
    data = [(k, (t or "").encode()) for k, t in rows]
    count = {}
    for _, b in data:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for key, b in data:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                hit[i : i + length] = True
        edge = np.diff(np.concatenate(([0], hit.astype(int), [0])))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((key, len(b), int(hit.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~hit])))
    return sorted(out, key=str)


def corpus(seed=2):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [text(n) for n in (18, 20, 25, 60, 200)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 3)
            parts += [s[a : len(s) - rng.randrange(0, len(s) // 3)], text(rng.randrange(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(100, "x" * 300), (101, "xy" * 90), (102, None), (103, ""), (104, rows[3][1]), (104, rows[3][1]), (None, shared[4])]
    return rows


@pytest.mark.parametrize(("length", "most", "batch"), [(20, 200_000, None), (20, 3, "7"), (21, 200_000, "5")])
def test_matches_brute_force(spark, length, most, batch):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, tid int, spans int")
    if batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = remove_repeats(docs.repartition(3), length=length, most_contexts=most).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    have = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got]
    assert sorted(have, key=str) == brute(rows, length)


def test_edges(spark):
    rows = [(r.doc_id, r.text) for r in edge_docs(spark).select("doc_id", "text").collect()]
    got = remove_repeats(edge_docs(spark)).collect()
    have = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got]
    assert sorted(have, key=str) == brute(rows, 200)
    assert remove_repeats(no_docs(spark)).agg(F.count("*")).first()[0] == 0


def test_every_window_holds_an_anchor_at_the_same_place():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 500).astype(np.uint8)
    at, prints = anchors(x, 20)
    assert all(((at >= i) & (at <= i + 10)).any() for i in range(481))
    again, same = anchors(np.concatenate((rng.integers(5, 9, 33).astype(np.uint8), x[100:160])), 20)
    inside = (again >= 33 + 10) & (again < 33 + 40)
    assert set(zip(again[inside] + 67, same[inside].tolist())) <= set(zip(at.tolist(), prints.tolist()))


def test_intervals_are_those_of_the_tree():
    assert list(intervals([3, 1, 2])) == [(3, 0, 1), (2, 2, 3), (1, 0, 3)]
    assert list(intervals([2, 2])) == [(2, 0, 2)]


def test_groups_name_all_occurrences_not_just_neighbours():
    # one anchor, length 4 (2 bytes on each side): a third row repeats neither neighbour but the first on the left
    after, before = [b"aa", b"ab", b"ac"], [b"xy", b"qq", b"xy"]
    row, name, left, right = repeat_groups(before, after, np.array([0]), 4)
    assert sorted(zip(row.tolist(), left.tolist(), right.tolist())) == [(0, 2, 1), (2, 2, 1)] and set(name) == {0}


def test_merged():
    assert merged(np.array([[5, 9], [0, 3], [3, 4], [6, 7]])).tolist() == [[0, 4], [5, 9]]
