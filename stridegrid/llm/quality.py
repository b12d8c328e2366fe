"""Quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegrid.llm.common import labelled_sample

#: Bytes of a passage, and bins of its byte pairs.
PASSAGE, BINS = 512, 512
_CLASSES = 8
_STATS = _CLASSES + 3
WIDTH = BINS + _STATS


def _byte_classes() -> np.ndarray:
    out = np.full(256, 6, np.int64)  # symbols
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            out[b] = 7
        elif c.isupper():
            out[b] = 0
        elif c.islower():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c in "\r\n":
            out[b] = 3
        elif c.isspace():
            out[b] = 4
        elif c in ".,;:!?'\"-()":
            out[b] = 5
    return out


_CLASS_OF = _byte_classes()
_FIRST = (np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
_SECOND = (np.arange(256, dtype=np.uint64) * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where each text starts and ends in them; null is empty."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    ends = np.where(column.is_valid().to_numpy(zero_copy_only=False), at[1:], at[:-1])
    return held, at[:-1], ends


def passages(starts: np.ndarray, ends: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every passage; texts are cut evenly, an empty text is one empty passage."""
    n = np.maximum(1, -(-(ends - starts) // size))
    owner = np.repeat(np.arange(len(starts)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = (ends - starts)[owner]
    return starts[owner] + number * width // n[owner], starts[owner] + (number + 1) * width // n[owner], owner


def features(held: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashed byte pairs, byte classes, variety and length of passages that lie one after another."""
    k = len(starts)
    out = np.zeros((k, WIDTH), np.float32)
    size = ends - starts
    owner = np.repeat(np.arange(k), size)
    within = np.concatenate([held[a:b] for a, b in zip(starts, ends, strict=True)]) if k else held[:0]
    if not len(within):
        return out
    count = np.maximum(1, size)[:, None].astype(np.float32)
    same = owner[1:] == owner[:-1]
    code = ((_FIRST[within[:-1]] + _SECOND[within[1:]]) & np.uint64(0xFFFFFFFF)) >> np.uint64(23)
    pairs = np.bincount(
        owner[:-1][same] * BINS + code[same].astype(np.int64), minlength=k * BINS
    ).reshape(k, BINS)
    kinds = np.bincount(owner * _CLASSES + _CLASS_OF[within], minlength=k * _CLASSES).reshape(k, _CLASSES)
    out[:, :BINS] = np.sqrt(pairs / count)
    out[:, BINS : BINS + _CLASSES] = kinds / count
    out[:, -3] = (pairs > 0).sum(axis=1) / np.minimum(count[:, 0], BINS)
    out[:, -2] = np.log1p(size) / 8
    out[:, -1] = pairs.max(axis=1) / count[:, 0]
    return out


@dataclass
class QualityModel:
    """Passage encoder, gated attention and the scorer of the weighted passage."""

    mean: np.ndarray
    spread: np.ndarray
    w: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.spread) @ self.w["enc"] + self.w["enc0"])

    def pooled(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of texts and attention of their passages; ``first``: first passage of each text."""
        gate = np.tanh(h @ self.w["v"]) / (1 + np.exp(-h @ self.w["u"]))
        s = gate @ self.w["att"]
        n = np.diff(np.append(first, len(s)))
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, first), n))
        a /= np.repeat(np.add.reduceat(a, first), n)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return 1 / (1 + np.exp(-np.clip(z @ self.w["out"] + self.w["out0"], -40, 40))), a


def fit_attention(
    x: np.ndarray, first: np.ndarray, y: np.ndarray, *, hidden: int = 24, gates: int = 12, epochs: int = 30, seed: int = 7
) -> QualityModel:
    """Encoder, gated attention and scorer by gradient descent on the log-loss of document labels."""
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 0.02
    x = ((x - mean) / spread).astype(np.float32)
    d = x.shape[1]
    normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    w = {
        "enc": normal(d, hidden),
        "enc0": np.zeros(hidden, np.float32),
        "v": normal(hidden, gates),
        "u": normal(hidden, gates),
        "att": normal(gates),
        "out": normal(hidden),
        "out0": np.zeros(1, np.float32),
    }
    m = {k: np.zeros_like(p) for k, p in w.items()}
    v = {k: np.zeros_like(p) for k, p in w.items()}
    n_of = np.diff(np.append(first, len(x)))
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            docs = order[i : i + 64]
            n = n_of[docs]
            own = np.repeat(np.arange(len(docs)), n)
            start = np.cumsum(n) - n
            at = np.repeat(first[docs] - start, n) + np.arange(n.sum())
            xb = x[at]
            h = np.tanh(xb @ w["enc"] + w["enc0"])
            t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-h @ w["u"]))
            s = (t * g) @ w["att"]
            a = np.exp(s - np.maximum.reduceat(s, start)[own])
            a /= np.add.reduceat(a, start)[own]
            z = np.add.reduceat(a[:, None] * h, start, axis=0)
            p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out0"], -40, 40)))
            dl = ((p - y[docs]) / len(docs)).astype(np.float32)
            dz = dl[:, None] * w["out"]
            da = (dz[own] * h).sum(axis=1)
            ds = a * (da - np.add.reduceat(a * da, start)[own])
            dt, dg = ds[:, None] * w["att"] * g * (1 - t * t), ds[:, None] * w["att"] * t * g * (1 - g)
            dh = (a[:, None] * dz[own] + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
            grads = {
                "enc": xb.T @ dh + 1e-4 * w["enc"],
                "enc0": dh.sum(axis=0),
                "v": h.T @ dt,
                "u": h.T @ dg,
                "att": (t * g).T @ ds,
                "out": z.T @ dl + 1e-4 * w["out"],
                "out0": dl.sum(keepdims=True),
            }
            step += 1
            for k, gr in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean.astype(np.float32), spread.astype(np.float32), w)


def _groups(sizes: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of passages of about ``most`` bytes."""
    block = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(block)) + 1
    yield from zip([0, *edges], [*edges, len(sizes)], strict=True)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    *,
    label: str = "quality",
    sample_rows: int = 6_000,
    sample_passages: int = 24,
) -> QualityModel | None:
    """Fit on at most ``sample_rows`` labelled documents; None without any.

    Of a document of more than ``sample_passages`` passages, evenly spread ones
    stand for it in training (the bound of the sample); scoring reads all.
    """
    sample = labelled_sample(docs, labels, label, train, sample_rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, starts, ends = text_bytes(batch.column("text"))
            a, b, owner = passages(starts, ends)
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            n = np.bincount(owner)[owner]
            take = (n <= sample_passages) | (rank * sample_passages // n != (rank - 1) * sample_passages // n)
            x = features(held, a[take], b[take]).astype(np.float16)
            parts = np.split(x, np.flatnonzero(np.diff(owner[take])) + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["doc_id", "_label", "x"],
            )

    kind = sample.schema["doc_id"].dataType.simpleString()
    # at most sample_rows rows of sample_passages small vectors come to the driver
    rows = sorted(sample.mapInArrow(encode, f"doc_id {kind}, _label int, x binary").collect())
    if not rows:
        return None
    x = [np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH) for r in rows]
    first = np.cumsum([0] + [len(p) for p in x])[:-1]
    y = np.array([r["_label"] > 0 for r in rows], np.float32)
    return fit_attention(np.concatenate(x).astype(np.float32), first, y)


def score_quality(docs: DataFrame, model: QualityModel | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Quality of every whole text: key, ``score`` (0 to 1) and ``focus``, the passage of most weight.

    One pass without shuffle; the model is broadcast and a task holds one batch
    of texts and passages of 4 MB at a time. Null and empty texts are one empty
    passage; repeated rows are judged each; other columns are not read. Without
    a model (no labelled row) every score is 0.5.
    """
    held_model = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held_model.value
        for batch in batches:
            held, starts, ends = text_bytes(batch.column("_text"))
            a, b, owner = passages(starts, ends)
            if not len(starts) or own is None:
                p, focus = np.full(len(starts), 0.5), np.zeros(len(starts), np.int64)
            else:
                h = np.concatenate([own.encode(features(held, a[i:j], b[i:j])) for i, j in _groups(b - a)])
                first = np.searchsorted(owner, np.arange(len(starts)))
                p, weight = own.pooled(h, first)
                best = np.maximum.reduceat(weight, first)[owner] == weight
                at = np.flatnonzero(best)
                focus = at[np.searchsorted(owner[at], np.arange(len(starts)))] - first
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(p.astype(np.float64)), pa.array(focus.astype(np.int64))],
                names=["_key", "score", "focus"],
            )

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(score, f"_key {kind}, score double, focus bigint").withColumnRenamed("_key", key)
