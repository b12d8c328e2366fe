import re

from edges import edge_docs, no_docs

from stridegrid.llm.decontaminate import decontaminate, judged, original_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, window):
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            b = words(body)
            size = min(window, len(b))
            for i in range(max(1, len(b) - window + 1) if b else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == b[i : i + size]:
                        hit.update(range(j, j + size))
                        if item is not None:
                            found.add(str(item))
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


DOCS = [
    (1, "It said: The Cat sat-on THE mat, and then; it slept!"),
    (2, "cat sat on the mat cat sat on the mat and"),
    (3, "Größe zählt überall, Größe zählt überall hier"),
    (4, None),
    (5, ""),
    (6, "... --- !!!"),
    (7, "nothing of the kind at all"),
    (7, "nothing of the kind at all"),
    (None, "the mat and then it"),
]
ITEMS = [(10, "the cat sat on the mat and then it"), (9, "größe zählt"), (9, "Größe zählt"), (11, None), (12, ""), (13, "?!"), (None, "OF THE KIND")]


def test_matches_brute_force_in_one_and_in_many_blocks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = brute(DOCS, ITEMS, 4)
    for block_bytes in (1_000_000, 8):
        got = decontaminate(docs, items, window=4, block_bytes=block_bytes).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=str) == want
        for r in got:
            assert all(0 <= s.start < s.end for s in r.spans)


def test_spans_are_offsets_of_the_original():
    text = "Größe – THE cat, sat-on it"
    assert [text[a:b] for a, b in original_spans(text, [(2, 5)])] == ["THE cat, sat"]
    assert original_spans(text, []) == []


def test_edges(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river bank today")], "item_id bigint, text string")
    got = judged(decontaminate(edge_docs(spark), items)).collect()
    assert sum(r.contaminated for r in got) == 2 and len(got) == 10
    assert decontaminate(no_docs(spark), items).count() == 0
    none = decontaminate(edge_docs(spark), items.where("false")).collect()
    assert len(none) == 10 and not any(r.n_hit for r in none)
