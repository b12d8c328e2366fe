import random
import zlib

import numpy as np
import pytest
from edges import edge_docs, no_docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stridegrid.llm.packing import Nested, WordCache, pack, pieces_of, schedule, tail_edges, windowed
from stridegrid.llm.queries import TOKENIZER


def test_cached_words_give_the_ids_of_whole_texts():
    cache, rng = WordCache(TOKENIZER), random.Random(4)
    pool = list("abc ABC .,'!?-\"\t\n012é ÉßΣσςİ一二ⅣⅫ²½́​  —“”…\x1c\x85😀ñÑ<|>_@#") + [
        "'s", "'ll", " don't ", "<|endoftext|>", "the", "Thing", "ﬁ", "ẞ", "ͅ", "K",
    ]
    for i in range(6000):
        plain = ["word", "Größe", ", ", ". ", ",\n", ".\n", "...", " a", "été", "!, ", "_, "]
        text = "".join(rng.choice(pool if i % 2 else plain) for _ in range(rng.randint(0, 25)))
        want = cache.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(cache.ids(text), cache.dtype).tolist() == want


@pytest.mark.parametrize(
    ("totals", "weights"),
    [([1000, 3000, 77, 1], [1000, 3000, 77, 1]), ([50000, 100, 100], [1, 1, 1]), ([9999], [1]), ([5, 0, 7], [5, 1e-9, 7])],
)
def test_schedule_gives_every_token_one_place_and_keeps_proportions(totals, weights):
    phases, rng = schedule(totals, weights, 64), random.Random(3)
    owner = np.full(sum(totals), -1)
    for queue, n in enumerate(totals):
        at = 0
        while at < n:
            size = min(n - at, rng.randint(1, 50))
            _, starts, lengths, places = pieces_of(phases, queue, np.array([at]), np.array([size]))
            assert starts[0] == at and lengths.sum() == size
            for place, length in zip(places, lengths, strict=True):
                assert (owner[place : place + length] == -1).all()
                owner[place : place + length] = queue
            at += size
    assert (owner >= 0).all()
    first = phases[0].weight / phases[0].weight.sum()
    until = (phases[1].at if len(phases) > 1 else len(owner)) // 64
    for queue, share in enumerate(first):  # deficits are carried: no window strays from its share by two tokens
        got = [(owner[64 * w : 64 * w + 64] == queue).sum() for w in range(max(0, until - 1))]
        assert all(abs(x - 64 * share) < 2 + len(totals) for x in got)
        assert all(abs(sum(got[:w]) - 64 * share * w) < 2 + len(totals) for w in range(len(got)))


def test_tail_is_powers_of_two():
    assert tail_edges(4096 + 1024 + 5, 4096) == [5120, 5124, 5125]
    assert tail_edges(8192, 4096) == [] and tail_edges(0, 4096) == []


def test_runs_are_cut_at_the_ends_of_sequences():
    run, at, size = windowed(np.array([3, 9]), np.array([4, 12]), np.array([4, 8, 16, 32]))
    assert sorted(zip(at.tolist(), size.tolist(), run.tolist())) == [(3, 1, 0), (4, 3, 0), (9, 7, 1), (16, 5, 1)]


def checked(docs, window, **options):
    rows = docs.select("doc_id", "text").collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = sorted(
        (str(r.doc_id), np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in rows
    )
    got = pack(docs, TOKENIZER, window=window, **options).withColumn("crc", F.crc32("ids")).collect()
    by_sequence, open_docs, have = {}, {}, []
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.start)):
        assert len(r.ids) == 4 * r.length > 0 and zlib.crc32(bytes(r.ids)) == r.crc
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        open_docs.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0
    for (key, n), pieces in open_docs.items():
        copies = sum(len(x) for _, x in pieces) // (4 * n)
        text = b"".join(x for _, x in sorted(pieces)[::copies]) if copies > 1 else b"".join(x for _, x in sorted(pieces))
        have += [(key, text)] * copies
    assert sorted(have) == want
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return got


def test_round_trip_of_edges(spark):
    checked(edge_docs(spark).where("doc_id IS NULL OR doc_id <> 1").unionByName(edge_docs(spark).where("doc_id = 1").limit(1)), 64)
    assert len(pack(edge_docs(spark), TOKENIZER).collect()) >= 10
    assert pack(no_docs(spark), TOKENIZER).count() == 0


def test_targets_and_shared_queue(spark):
    rows = [(i, f"word{i} " * (i % 7 + 3), f"s{i % 9}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    checked(docs, 128, queues=3)
    got = checked(docs, 128, targets={"s1": 0.5, "absent": 0.1})
    source = {i: s for i, _, s in rows}
    first = [sum(r.length for r in got if r.sequence_id == w and source[r.doc_id] == "s1") for w in range(4)]
    assert all(abs(x - 64) <= 9 for x in first)  # a window may begin within a round


def test_small_source_named_in_targets_is_a_queue(spark):
    rows = [(i, f"word{i} " * 9, "tiny" if i % 40 == 0 else f"s{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = checked(docs, 128, targets={"tiny": 0.5}, queues=2)
    source = {i: s for i, _, s in rows}
    first = [sum(r.length for r in got if r.sequence_id == w and source[r.doc_id] == "tiny") for w in range(2)]
    assert all(abs(x - 64) <= 9 for x in first)


@pytest.mark.parametrize("fan", [256, 4])
def test_sources_beyond_the_outer_queues_keep_their_share(spark, fan):
    rows = [(i, "word and more text " * 8, f"s{i % 40}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = checked(docs, 1024, queues=3, fan=fan)
    source = {i: s for i, _, s in rows}
    total, windows = sum(r.length for r in got), sum(r.length for r in got) // 1024
    share = 1024 / 40
    have = {}
    for r in got:
        have[source[r.doc_id], r.sequence_id] = have.get((source[r.doc_id], r.sequence_id), 0) + r.length
    # of a queue's own rounds one may fall on each side of a window
    for w in range(windows - 2):
        for i in range(40):
            assert abs(sum(have.get((f"s{i}", v), 0) for v in range(w + 1)) - share * (w + 1)) < 2 * share, (i, w)
            assert have.get((f"s{i}", w), 0) > 0
    assert total == sum(have.values())


def test_nested_schedules_give_every_token_one_place():
    rng = np.random.default_rng(5)
    for groups in (1, 3, 700):
        group = np.sort(rng.integers(0, groups, 900))
        totals = rng.integers(1, 60, 900)
        nested = Nested.of(group, totals, groups, 40.0, 16)
        member = np.arange(900) - nested.bounds[group]
        doc, start, length, place = nested.pieces(group, member, np.zeros(900, np.int64), totals, {})
        assert (np.bincount(doc, length, 900) == totals).all()
        order = np.argsort(place)
        assert place[order[0]] == 0 and (place[order][1:] == (place + length)[order][:-1]).all()
        assert (place + length).max() == totals.sum()
