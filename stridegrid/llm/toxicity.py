"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegrid.llm.common import labelled_sample, staged, trimmed

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7, 8)


def term_counts(text: str | None) -> tuple[Counter, int]:
    """Counts of lower-cased words and of word beginnings (``abcd*``), and the number of words."""
    words = Counter(_WORD.findall((text or "").lower()))
    terms = Counter(words)
    for word, n in words.items():
        for size in PREFIXES:
            if len(word) > size:
                terms[f"{word[:size]}*"] += n
    return terms, words.total()


@dataclass
class OrdinalModel:
    """Shared weights of the terms and of text length, ordered thresholds between the grades."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    length_weight: float
    thresholds: np.ndarray

    def level(self, text: str | None) -> float:
        """The latent severity of a text."""
        terms, n = _known(text, self.vocabulary)
        at = np.fromiter(terms, np.int64, len(terms))
        value = np.log1p(np.fromiter(terms.values(), np.float64, len(terms)))
        return float(self.weights[at] @ value) + self.length_weight * math.log1p(n)

    def exceeds(self, levels: np.ndarray) -> np.ndarray:
        """P(grade > k) for each level and threshold k."""
        return 1 / (1 + np.exp(-np.clip(levels[:, None] - self.thresholds[None, :], -40, 40)))


def _known(text: str | None, vocabulary: dict[str, int]) -> tuple[dict[int, int], int]:
    """Counts of the terms of a vocabulary, by their number; only known terms are built."""
    counts: dict[int, int] = {}
    words = Counter(_WORD.findall((text or "").lower()))
    for word, n in words.items():
        at = vocabulary.get(word)
        if at is not None:
            counts[at] = counts.get(at, 0) + n
        for size in PREFIXES:
            if len(word) > size and (at := vocabulary.get(f"{word[:size]}*")) is not None:
                counts[at] = counts.get(at, 0) + n
    return counts, words.total()


def fit_ordinal(
    features: np.ndarray, grades: np.ndarray, levels: int, *, ridge: float = 2e-5, steps: int = 600, rate: float = 0.1
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds that maximise the cumulative-link likelihood (logit link).

    Thresholds are a first value and positive gaps, so that they stay ordered;
    all thresholds share the weights. Full-batch Adam, deterministic.
    """
    n, d = features.shape
    w = np.zeros(d)
    raw = np.concatenate(([2.0], np.zeros(levels - 2)))  # threshold 0, logs of the gaps
    m, v = np.zeros(d + levels - 1), np.zeros(d + levels - 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    row = np.arange(n)
    for step in range(1, steps + 1):
        theta = raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))
        s = features @ w
        below = np.concatenate(
            (np.zeros((n, 1)), sigmoid(theta[None, :] - s[:, None]), np.ones((n, 1))), axis=1
        )  # P(grade < k)
        hi, lo = below[row, grades + 1], below[row, grades]
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_s = (d_hi - d_lo) / n  # of the negative log-likelihood
        g_theta = np.zeros(levels + 1)
        np.add.at(g_theta, grades + 1, -d_hi / n)
        np.add.at(g_theta, grades, d_lo / n)
        g_theta = g_theta[1:levels]
        tail = np.cumsum(g_theta[::-1])[::-1]
        g_raw = np.concatenate(([tail[0]], tail[1:] * np.exp(raw[1:])))
        g = np.concatenate((features.T @ g_s + ridge * w, g_raw))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:d]
        raw -= move[d:]
    return w, raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    *,
    label: str = "toxic",
    grades: int = 4,
    sample_rows: int = 12_000,
    terms: int = 1024,
    least_documents: int = 5,
    least_score: float = 4.0,
) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled documents.

    Terms are those whose documents are labelled 1 more often than chance: at
    least ``least_documents`` of them and a signed root of the likelihood ratio
    of ``least_score``, the best ``terms`` of them. Labels have two values, so
    severity grades of toxic documents are quantiles of their evidence, the sum
    of the log-odds of their terms; documents labelled 0 are grade 0. Without a
    labelled row of either kind every level is far below the first threshold.
    """
    sample = staged(labelled_sample(docs, labels, label, train, sample_rows), "toxic-sample")
    n = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    nothing = OrdinalModel({}, np.zeros(0), 0.0, np.full(grades - 1, 30.0) + np.arange(grades - 1))
    if not n.get(1) or not n.get(0):
        return nothing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("_label").to_pylist(), strict=True):
                seen[int(y > 0)].update(term_counts(text)[0].keys())
            names = list(seen[0].keys() | seen[1].keys())
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.string()),
                        pa.array([seen[1][x] for x in part], pa.int64()),
                        pa.array([seen[0][x] for x in part], pa.int64()),
                    ],
                    names=["term", "pos", "neg"],
                )

    counted = (
        sample.mapInArrow(trimmed(count), "term string, pos bigint, neg bigint")
        .groupBy("term")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    total, share = n[1] + n[0], n[1] / (n[1] + n[0])
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    both = pos + neg
    rate = pos / both
    gain = pos * F.log(rate / share) + F.when(neg > 0, neg * F.log((neg / both) / (1 - share))).otherwise(0.0)
    picked = (
        counted.where(f"pos >= {least_documents}")
        .withColumn("score", F.when(rate > share, F.sqrt(F.greatest(2 * gain, F.lit(0.0)))).otherwise(0.0))
        .where(F.col("score") >= least_score)
        .orderBy(F.desc("score"), "term")
        .limit(terms)
        .collect()
    )
    full = {(r["term"].rstrip("*")[:size], r["pos"], r["neg"]) for r in picked for size in PREFIXES if len(r["term"].rstrip("*")) > size}
    # a beginning with the very counts of a longer term says nothing more
    picked = [r for r in picked if not r["term"].endswith("*") or (r["term"][:-1], r["pos"], r["neg"]) not in full]
    if not picked:
        return nothing
    vocabulary = {r["term"]: i for i, r in enumerate(picked)}
    odds = np.array(
        [math.log((r["pos"] + 0.5) / (n[1] + 1)) - math.log((r["neg"] + 0.5) / (n[0] + 1)) for r in picked]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_known(t, vocabulary) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("_label"),
                    pa.array([n for _, n in found], pa.int64()),
                    pa.array([list(c) for c, _ in found], pa.list_(pa.int32())),
                    pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int32())),
                ],
                names=["doc_id", "_label", "n", "at", "count"],
            )

    kind = sample.schema["doc_id"].dataType.simpleString()
    # at most sample_rows short rows come to the driver
    table = sorted(
        sample.mapInArrow(trimmed(rows), f"doc_id {kind}, _label int, n bigint, at array<int>, count array<int>").collect()
    )
    x = np.zeros((len(table), len(vocabulary) + 1))
    for i, r in enumerate(table):
        x[i, r["at"]] = np.log1p(r["count"])
        x[i, -1] = math.log1p(r["n"])
    y = np.array([r["_label"] > 0 for r in table])
    evidence = x[:, :-1] @ odds
    cuts = np.quantile(evidence[y], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(y, 1 + np.searchsorted(cuts, evidence, side="right"), 0)
    middle = x[:, -1].mean()
    x[:, -1] -= middle
    w, theta = fit_ordinal(x, grade, grades)
    return OrdinalModel(vocabulary, w[:-1], float(w[-1]), theta + w[-1] * middle)


def score_toxicity(
    docs: DataFrame, model: OrdinalModel, *, key: str = "doc_id", text: str = "text", cut: float = 0.5
) -> DataFrame:
    """Severity of every document: key, ``severity``, ``grade``, ``p_toxic`` and ``toxic``.

    ``severity`` is the expected grade, ``grade`` the likeliest, ``p_toxic``
    the probability of any grade above 0, ``toxic`` whether that reaches
    ``cut``. The model (a bounded vocabulary) is broadcast and the rows make
    one pass without shuffle. Null and empty texts are scored as texts without
    words; repeated rows are judged each; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            levels = np.array([own.level(t) for t in batch.column("_text").to_pylist()], np.float64)
            over = own.exceeds(levels)
            p = -np.diff(np.concatenate((np.ones((len(levels), 1)), over, np.zeros((len(levels), 1))), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    pa.array(over.sum(axis=1)),
                    pa.array(p.argmax(axis=1).astype(np.int32)),
                    pa.array(over[:, 0]),
                    pa.array(over[:, 0] >= cut),
                ],
                names=["_key", "severity", "grade", "p_toxic", "toxic"],
            )

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    out = rows.mapInArrow(trimmed(score), f"_key {kind}, severity double, grade int, p_toxic double, toxic boolean")
    return out.withColumnRenamed("_key", key)
