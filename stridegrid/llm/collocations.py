"""Frequent phrases by set-oriented relational mining of sorted occurrence relations."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridegrid.llm.common import few_rows, staged, trimmed

#: Frequent phrases of one length that are broadcast at most (24 bytes each; words: their bytes); more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
_MOST_BYTES = 64 << 20
_HELD = 100_000
#: Parts in which the phrases of a language are ranked before they meet.
_PARTS = 64

_TABLE = bytearray(range(256))
_TABLE[0x41:0x5B] = bytes(range(0x61, 0x7B))
for _b in b",;:!?\n\x0b\x0c\r":
    _TABLE[_b] = ord(".")
_TABLE = bytes(_TABLE)
_PLACES = "row bigint, places array<int>, codes array<bigint>"


def piece_words(text: str | None) -> list[bytes]:
    """Words in order, with ``.`` where a piece ends; A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(b".", b" . ").split()


def _placed(words: list[bytes]) -> np.ndarray:
    """The place of every word; places of different pieces are never adjacent."""
    return np.flatnonzero(np.fromiter((w != b"." for w in words), bool, len(words))).astype(np.int32)


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, words, f) for every word, counted in the task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, w.decode("utf-8", "surrogatepass"), f) for lang, c in held.items() for w, f in c.items() if w != b"."]
            held.clear()
            lang, word, f = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(f, pa.int64())], names=["lang", "word", "f"]
            )

        for batch in few_rows(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[lang].update(piece_words(text))
                if sum(map(len, held.values())) > _HELD:
                    yield out()
        yield out()

    rows = docs.mapInArrow(trimmed(count), "lang string, word string, f bigint")
    return rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _coded(frequent: DataFrame) -> DataFrame:
    """``frequent`` with a code per row, fixed by writing it."""
    return staged(frequent.withColumn("code", F.monotonically_increasing_id()), "frequent")


def _kept(occurrences: DataFrame, frequent: DataFrame, keys: list[str]) -> DataFrame:
    """The semi-join by a shuffle: occurrences (row, place, keys) of frequent groups, sorted again per row."""
    found = occurrences.join(frequent.select(*keys, "code"), keys).groupBy("row")
    found = found.agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("at"))
    return found.select("row", F.col("at.place").alias("places"), F.col("at.code").alias("codes"))


def _first_relation(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """Occurrences of the frequent words of every text: places in ascending order and codes."""
    size = frequent.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + 100), F.lit(0))).first()
    if size[0] > MOST_BROADCAST or size[1] > _MOST_BYTES:

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in few_rows(batches):
                for row, lang, text in zip(*(batch.column(x).to_pylist() for x in ("row", "lang", "text")), strict=True):
                    words = piece_words(text)
                    at = _placed(words)
                    held = [words[p].decode("utf-8", "surrogatepass") for p in at.tolist()]
                    m = len(held)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, row)), pa.array([lang] * m, pa.string()), pa.array(at), pa.array(held, pa.string())],
                        names=["row", "lang", "place", "word"],
                    )

        return _kept(docs.mapInArrow(trimmed(split), "row bigint, lang string, place int, word string"), frequent, ["lang", "word"])
    codes: dict[str, dict[bytes, int]] = defaultdict(dict)
    for r in frequent.select("lang", "word", "code").toArrow().to_pylist():  # bounded by the check above
        codes[r["lang"]][r["word"].encode("utf-8", "surrogatepass")] = r["code"]
    known = docs.sparkSession.sparkContext.broadcast(dict(codes))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            places, found = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = piece_words(text)
                get = known.value.get(lang, {}).get
                code = np.array([get(w, -1) for w in words], np.int64)
                at = np.flatnonzero(code >= 0)
                places.append(at.astype(np.int32))
                found.append(code[at])
            yield _relation(batch.column("row"), places, found)

    return docs.mapInArrow(trimmed(look), _PLACES)


def _relation(row: pa.Array, places: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(x) for x in places]).astype(np.int32)
    lists = [
        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else np.zeros(0, t), pa.from_numpy_dtype(t)))
        for x, t in ((places, np.int32), (codes, np.int64))
    ]
    return pa.RecordBatch.from_arrays([row, *lists], names=["row", "places", "codes"])


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merge-join of the relation with itself at adjacent places: index of the row, place, both codes."""
    lists = [batch.column(x) for x in ("places", "codes")]
    places, codes = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    row = np.repeat(np.arange(batch.num_rows), lists[0].value_lengths().to_numpy(zero_copy_only=False))
    at = np.flatnonzero((places[1:] == places[:-1] + 1) & (row[1:] == row[:-1]))
    return row[at], places[at], codes[at], codes[at + 1]


def _pair_counts(relation: DataFrame) -> DataFrame:
    """(a, b, f): how often phrase b stands one word after phrase a, counted in the task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            a, b, f = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((b, a))
            a, b, f = a[order], b[order], f[order]
            starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            return (a[starts], b[starts], np.add.reduceat(f, starts)) if len(a) else (a, b, f)

        def out() -> pa.RecordBatch:
            one = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in one], names=["a", "b", "f"])

        fresh = 0
        for batch in few_rows(batches):
            _, _, a, b = _joined(batch)
            held.append((a, b, np.ones(len(a), np.int64)))
            fresh += len(a)
            if fresh > 4 * _HELD:
                held[:] = [merged()]
                fresh = 0
                if len(held[0][0]) > _HELD:
                    yield out()
        if held:
            held[:] = [merged()]
            yield out()

    rows = relation.select("places", "codes").mapInArrow(trimmed(count), "a bigint, b bigint, f bigint")
    return rows.groupBy("a", "b").agg(F.sum("f").alias("f"))


def _next_relation(relation: DataFrame, frequent: DataFrame) -> DataFrame:
    """Occurrences of the phrases one word longer, without those that are not frequent."""
    if frequent.count() > MOST_BROADCAST:

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in few_rows(batches):
                row, place, a, b = _joined(batch)
                row = batch.column("row").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, place, a, b)], names=["row", "place", "a", "b"])

        return _kept(relation.mapInArrow(trimmed(pairs), "row bigint, place int, a bigint, b bigint"), frequent, ["a", "b"])
    table = frequent.select("a", "b", "code").toArrow()  # bounded by the check above
    a, b, code = (table.column(x).to_numpy() for x in ("a", "b", "code"))
    firsts, seconds = np.unique(a), np.unique(b)
    key = np.searchsorted(firsts, a) * len(seconds) + np.searchsorted(seconds, b)
    order = np.argsort(key)
    known = relation.sparkSession.sparkContext.broadcast((firsts, seconds, key[order], code[order]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds, key, code = known.value
        for batch in few_rows(batches):
            row, place, a, b = _joined(batch)
            if not len(key):
                row = row[:0]
            i, ok_a = _found(firsts, a)
            j, ok_b = _found(seconds, b)
            at, ok = _found(key, i * len(seconds) + j)
            ok &= ok_a & ok_b
            ends = np.cumsum(np.bincount(row[ok], minlength=batch.num_rows))[:-1] if batch.num_rows else []
            yield _relation(batch.column("row"), np.split(place[ok], ends), np.split(code[at[ok]], ends))

    return relation.mapInArrow(trimmed(look), _PLACES)


def _found(held: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``asked`` in the ascending ``held``, and whether they are there."""
    if not len(held):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
    return at, held[at] == asked


def frequent_phrases(docs: DataFrame, *, most: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``most`` words that occur ``least`` times in a language, and the words per language.

    First: lang, words (array), f, code, a, b; codes are those of one length,
    a and b the codes of the phrase without its last and without its first
    word. Second: lang, n.

    The occurrence relation of each length is written with its rows in order of
    text, piece and place. A length is joined with itself at adjacent places and
    counted; only occurrences of frequent groups form the relation of the next
    length. Texts and langs are read as the contract of ``collocations`` says.
    """
    docs = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    counts = staged(_word_counts(docs.select("lang", "text")), "word-counts")
    frequent = _coded(counts.where(F.col("f") >= least))
    named = frequent.select(
        "lang", F.array("word").alias("words"), "f", "code", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b")
    )
    levels = [named]
    relation = staged(_first_relation(docs, frequent), "occurrences")
    for size in range(2, most + 1):
        frequent = _coded(_pair_counts(relation).where(F.col("f") >= least))
        before = levels[-1]
        firsts = before.select(F.col("code").alias("a"), "lang", F.col("words").alias("head"))
        lasts = before.select(F.col("code").alias("b"), F.element_at("words", -1).alias("last"))
        grown = frequent.join(firsts, "a").join(lasts, "b")
        levels.append(
            staged(grown.select("lang", F.array_append("head", F.col("last")).alias("words"), "f", "code", "a", "b"), "phrases")
        )
        if size < most:
            relation = staged(_next_relation(relation, frequent), "occurrences")
    return reduce(DataFrame.union, levels), counts.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, *, most: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of every language by their association: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``most`` words with a >= ``least`` occurrences is cut after
    each of its words but the last; l and r are the occurrences of the parts, n
    all words of the language. Its score is the least floor(1000 a n / (l r)),
    from the first such cut. Phrases that stand in a longer one with as many
    occurrences are left out. Order: score, then a, descending, then the bytes
    of the phrase. Products are decimals of 38 digits.

    ``docs`` has text and lang; null texts are empty, a null lang is ``und``,
    repeated rows count each. Pieces end at ``. , ; : ! ?`` and at line ends;
    no phrase crosses one. An empty table, or one without frequent phrases,
    gives no rows. Other columns are not read.
    """
    phrases, totals = frequent_phrases(docs, most=most, least=least)
    phrases = staged(phrases.withColumn("k", F.size("words")).withColumn("phrase", F.array_join("words", " ")), "all-phrases")
    longer = phrases.where("k > 1").select(F.col("k").alias("up"), "f", F.explode(F.array("a", "b")).alias("code"))
    longer = longer.groupBy(F.col("code"), (F.col("up") - 1).alias("k")).agg(F.max("f").alias("above"))
    open_ = phrases.where("k > 1").join(longer, ["code", "k"], "left").where("above IS NULL OR above < f")
    cuts = open_.select(
        "lang", "phrase", F.col("f").alias("a"), "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    ).select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    lefts = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(totals, "lang")
    exact = "CAST({} AS DECIMAL(20, 0))"
    score = F.expr(f"(1000BD * {exact.format('a')} * {exact.format('n')}) div ({exact.format('l')} * {exact.format('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("at")
    )
    ranked = best.select("lang", "phrase", "a", "at.l", "at.r", "n", "at.score")
    for keys in (("lang", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))), ("lang",)):  # the first of each part, then of all
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
