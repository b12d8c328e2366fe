"""Tables with nulls, empty and long texts, repeated rows and columns of clashing names."""

from __future__ import annotations

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
LONG = " ".join(f"{w}{i}" for i in range(400) for w in WORDS)
CLASHES = "_key bigint, _text string, _tid bigint, tid string, sid string, n string, spans string, score string"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"


def edge_docs(spark):
    clash = (7, "x", 9, "t", "s", "n", "p", "c")
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70, *clash),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70, *clash),
        (2, None, None, None, None, *[None] * 8),
        (3, "", "en", "", 0, *clash),
        (4, "  \n\t ", None, "b", 5, *clash),
        (5, LONG, "en", "a", len(LONG), *clash),
        (6, LONG + " tail", "en", None, len(LONG) + 5, *clash),
        (None, "no key here but words enough to make shingles of five", "de", "b", 50, *clash),
        (8, "Größe und ß – 日本語 😀 <|endoftext|> 12345 !!!", "de", "b", 40, *clash),
        (9, "one two", "fr", "c", 7, *clash),
    ]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def edge_labels(spark):
    rows = [(1, 1, 0, "x"), (5, 1, 0, "x"), (8, 0, 1, "x"), (None, 1, 0, "x"), (9, None, None, "x"), (9, 0, 1, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int, text string")
