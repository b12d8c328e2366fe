import random
from collections import Counter

import pytest
from edges import edge_docs, no_docs

from stridegrid.llm import collocations as module
from stridegrid.llm.collocations import collocations, piece_words


def brute(rows, least, top, most=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ",;:!?\n\x0b\x0c\r":
            low = low.replace(c, ".")
        for piece in low.split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    held = {p: c for p, c in f.items() if c >= least}
    above = Counter()
    for (lang, *y), c in held.items():
        for k in range(1, len(y)):
            for i in range(len(y) - k + 1):
                part = (lang, *y[i : i + k])
                above[part] = max(above[part], c)
    rows = []
    for (lang, *w), a in held.items():
        w = tuple(w)
        if len(w) < 2 or above[(lang, *w)] >= a:
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang]))
    out, rank = [], Counter()
    for lang, s, a, p, l, r, total in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, l, r, total, -s))
    return out


def corpus():
    rng = random.Random(4)
    words = [f"W{i}" for i in range(12)] + ["été", "日本", "x\x00y", "a b"]
    held = ["new york city", "in the long run", "a b c d e f"]
    rows = []
    for i in range(60):
        parts = [rng.choice(held) if rng.random() < 0.4 else rng.choice(words) for _ in range(40)]
        text = "".join(p + rng.choice((" ", " ", "  ", "\t", ". ", ",", "\n", "!?")) for p in parts)
        rows.append((rng.choice(("en", "en", "de", None)), text))
    return rows + [("en", None), ("en", ""), ("de", " .\t,"), ("fr", "few words only"), ("en", "a a a a a a a a a a a a a")]


@pytest.mark.parametrize("tight", [False, True])
def test_matches_brute_force(spark, monkeypatch, tight):
    if tight:  # semi-joins by shuffles, counts that leave the task early, a small top
        monkeypatch.setattr(module, "MOST_BROADCAST", 0)
        monkeypatch.setattr(module, "_HELD", 5)
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    top = 7 if tight else 2000
    got = sorted(map(tuple, collocations(docs, least=8, top=top).collect()))
    want = sorted(brute(rows, 8, top))
    assert got == want and len(want) > 10


def test_edges(spark):
    assert collocations(no_docs(spark)).count() == 0
    rows = [(r.lang, r.text) for r in edge_docs(spark).collect()]
    assert sorted(map(tuple, collocations(edge_docs(spark), least=2).collect())) == sorted(brute(rows, 2, 2000))


def test_products_beyond_64_bits(spark):
    score = "(1000BD * CAST(a AS DECIMAL(20, 0)) * CAST(n AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) * CAST(r AS DECIMAL(20, 0)))"
    a, n, l, r = 10**13 - 1, 10**15 + 7, 10**13 + 3, 10**13 + 9
    got = spark.sql(f"SELECT {score} FROM VALUES ({a}L, {n}L, {l}L, {r}L) AS t(a, n, l, r)").first()[0]
    assert got == 1000 * a * n // (l * r)


def test_pieces():
    assert piece_words("Ab c.D\te!\nf") == [b"ab", b"c", b".", b"d", b"e", b".", b".", b"f"]
