"""Benchmark decontamination with one automaton over normalised windows of test items."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridegrid.llm.common import trimmed

#: Bytes to blank out or lower: separators are ASCII but for digits and letters, words keep the rest.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: Bytes of item texts that one automaton holds; larger benchmarks are scanned block by block.
BLOCK_BYTES = 16_000_000


def folded_words(text: str | None) -> list[bytes]:
    """Words of a text as bytes, A-Z lower-cased; every byte of a word stays what it was."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(items: list[tuple[str | None, str | None]], window: int) -> dict[bytes, set[str | None]]:
    """Each window of ``window`` words with its items; an item of fewer words is one window."""
    found: dict[bytes, set[str | None]] = {}
    for item, text in items:
        words = folded_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" ".join(words[i : i + window]), set()).add(item)
    return found


def _automaton(windows: dict[bytes, set[str | None]]) -> ahocorasick.Automaton | None:
    machine = ahocorasick.Automaton()
    for text, items in windows.items():
        machine.add_word(f" {text.decode('latin-1')} ", (len(text) + 2, text.count(b" ") + 1, items))
    if not windows:
        return None
    machine.make_automaton()
    return machine


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits(machine: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
    """Half-open runs of hit words, and the items found."""
    line = b" %b " % b" ".join(words)
    spans, items, spaces = [], set(), None
    for end, (size, count, owners) in machine.iter(line.decode("latin-1")):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        at = int(np.searchsorted(spaces, end - size + 1))
        spans.append((at, at + count))
        items |= owners
    return _merge(spans), items


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in ``text`` of runs of its words."""
    if not runs:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(_FOLD), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in runs]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Words of each document inside any occurrence of a window of a benchmark item.

    A window is ``window`` consecutive words of an item; an item of fewer
    words, but not none, is one window. Text is scanned once, as normalised
    bytes, by one Aho-Corasick automaton; hits are mapped to the original text.
    A benchmark of more than ``block_bytes`` is scanned in several blocks of
    items, one automaton each, so that no task holds more than one block's.

    Returns per row: the key, ``n_words``, ``n_hit``, ``items`` (ids as text,
    sorted, each once) and ``spans`` (character offsets of hit runs). Null and
    empty texts have no words; repeated rows are judged each; an empty
    benchmark hits nothing; items without id hit but are not listed; further
    columns of either table are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_key).cast("string").alias("i"), F.col(item_text).alias("t")).where(
        F.col("t").isNotNull()
    )
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([(r.i, r.t) for r in part.toLocalIterator()])
        first, last = block == 0, block == blocks - 1

        def scan(
            batches: Iterator[pa.RecordBatch], held=held, first: bool = first, last: bool = last
        ) -> Iterator[pa.RecordBatch]:
            machine = _automaton(windows_of(held.value, window))
            for batch in batches:
                n_words, runs, names, spans = [], [], [], []
                texts = batch.column("_text").to_pylist()
                before = (
                    [([], [])] * len(texts)
                    if first
                    else [
                        (list(zip(a, b, strict=True)), c)
                        for a, b, c in zip(
                            *(batch.column(x).to_pylist() for x in ("_from", "_to", "_items")), strict=True
                        )
                    ]
                )
                for body, (seen, known) in zip(texts, before, strict=True):
                    words = folded_words(body)
                    found, owners = _hits(machine, words) if machine and words else ([], set())
                    found = _merge([*seen, *found])
                    n_words.append(len(words))
                    runs.append(found)
                    names.append(sorted({*known, *(x for x in owners if x is not None)}))
                    spans.append([{"start": a, "end": b} for a, b in original_spans(body, found)] if last else None)
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_key"),
                        batch.column("_text") if not last else pa.nulls(len(texts), pa.string()),
                        pa.array(n_words, pa.int64()),
                        pa.array([[a for a, _ in r] for r in runs], pa.list_(pa.int32())),
                        pa.array([[b for _, b in r] for r in runs], pa.list_(pa.int32())),
                        pa.array(names, pa.list_(pa.string())),
                        pa.array(spans, span),
                    ],
                    names=["_key", "_text", "n_words", "_from", "_to", "_items", "spans"],
                )

        kind = rows.schema["_key"].dataType.simpleString()
        rows = rows.mapInArrow(
            trimmed(scan),
            f"_key {kind}, _text string, n_words bigint, _from array<int>, _to array<int>, "
            "_items array<string>, spans array<struct<start:int,end:int>>",
        )
    hit = F.aggregate(
        F.zip_with("_to", "_from", lambda b, a: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x
    )
    return rows.select(
        F.col("_key").alias(key), "n_words", hit.alias("n_hit"), F.col("_items").alias("items"), "spans"
    )


def judged(found: DataFrame, *, share: int = 20) -> DataFrame:
    """The result of ``decontaminate`` with ``contaminated``: at least one of ``share`` words is hit."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
