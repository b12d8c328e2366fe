"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegrid.llm.common import labelled_sample, one_blas_thread
from stridegrid.llm.quality import passages, text_bytes

#: Bytes of a segment: the network runs over whole texts, segment by segment.
SEGMENT = 64
#: Segments that run side by side: few enough that the states of all positions stay in a core's cache.
LANES = 512


def _squash(x: np.ndarray) -> np.ndarray:
    """The logistic function of 2x, in place."""
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _shares(s: np.ndarray) -> np.ndarray:
    """Probabilities of each column of sums, in place."""
    s -= s.max(axis=0)
    np.exp(s, out=s)
    s /= s.sum(axis=0)
    return s


@dataclass
class ByteNetwork:
    """Weights of both directions and of the label layer; features come first, texts side by side.

    ``table``: (2, 3H, 256) what a byte adds to update gate, reset gate and
    candidate; ``state``: (2, 3H, H) the same for the state; ``out``: (K, 2H).
    Gates are logistic functions of twice their sum.
    """

    languages: list[str]
    table: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def step(self, way: int, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state, gates, candidate and the state's part of the candidate, each (., lanes)."""
        size = len(h)
        x = self.table[way].take(byte, axis=1)
        r = self.state[way] @ h
        gates = x[: 2 * size]
        gates += r[: 2 * size]
        _squash(gates)
        new = x[2 * size :]
        new += gates[size:] * r[2 * size :]
        np.tanh(new, out=new)
        return h + gates[:size] * (new - h), gates, new, r[2 * size :]

    def states(self, bytes_: np.ndarray, valid: np.ndarray, way: int) -> np.ndarray:
        """States at every position: (steps, H, lanes); zero where not valid."""
        steps, lanes = bytes_.shape
        size = self.state.shape[2]
        h = np.zeros((size, lanes), np.float32)
        seen = np.empty((steps, size, lanes), np.float32)
        full = valid.all(axis=1)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            h = self.step(way, bytes_[t], h)[0]
            if not full[t]:
                h *= valid[t]
            seen[t] = h
        return seen

    def labels(self, seen: tuple[np.ndarray, np.ndarray], t: int) -> np.ndarray:
        """Language probabilities at one position: (K, lanes)."""
        size = self.state.shape[2]
        return _shares(self.out[:, :size] @ seen[0][t] + self.out[:, size:] @ seen[1][t] + self.bias[:, None])

    def summed(self, bytes_: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Language probabilities summed over the positions of each lane: (K, lanes).

        Weights come out of training as doubles and are used in single precision.
        Of the backward states only their part of the labels is kept, and the
        forward ones are used as they come; all arrays of a step are used again.
        """
        (steps, lanes), size = bytes_.shape, self.state.shape[2]
        columns = [np.ascontiguousarray(t.T, np.float32) for t in self.table]
        state, out, bias = (w.astype(np.float32) for w in (self.state, self.out, self.bias[:, None]))
        at = bytes_.astype(np.intp)
        rows, x = np.empty((lanes, 3 * size), np.float32), np.empty((3 * size, lanes), np.float32)
        r, change = np.empty_like(x), np.empty((size, lanes), np.float32)
        gates, new = x[: 2 * size], x[2 * size :]
        full = valid.all(axis=1)
        later = np.empty((steps, len(self.out), lanes), np.float32)
        total = np.zeros((len(self.out), lanes), np.float64)
        for way in (1, 0):
            h = np.zeros((size, lanes), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                np.take(columns[way], at[t], axis=0, out=rows, mode="clip")
                np.copyto(x, rows.T)
                np.matmul(state[way], h, out=r)
                gates += r[: 2 * size]
                _squash(gates)
                r[2 * size :] *= gates[size:]
                new += r[2 * size :]
                np.tanh(new, out=new)
                np.subtract(new, h, out=change)
                change *= gates[:size]
                h += change
                if not full[t]:
                    h *= valid[t]
                if way == 1:
                    np.matmul(out[:, size:], h, out=later[t])
                    continue
                s = out[:, :size] @ h
                s += later[t]
                s += bias
                p = _shares(s)
                total += p if full[t] else p * valid[t]
        return total


def _laid_out(held: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments as columns: bytes (steps, lanes) and which of them are text."""
    size = ends - starts
    at = starts[None, :] + np.arange(SEGMENT)[:, None]
    valid = np.arange(SEGMENT)[:, None] < size[None, :]
    return held[np.where(valid, at, 0)], valid


def _backward(
    net: ByteNetwork, bytes_: np.ndarray, valid: np.ndarray, way: int, seen: np.ndarray, d_seen: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of one direction's tables by backpropagation through time."""
    steps, lanes = bytes_.shape
    size = net.state.shape[2]
    d_table, d_state = np.zeros((256, 3 * size), np.float32), np.zeros_like(net.state[way])
    order = range(steps) if way == 0 else range(steps - 1, -1, -1)
    dh = np.zeros((size, lanes), np.float32)
    zero = np.zeros((size, lanes), np.float32)
    for t in reversed(order):
        before = t - 1 if way == 0 else t + 1
        h = seen[before] if 0 <= before < steps else zero
        _, gates, new, r = net.step(way, bytes_[t], h)
        z, g = gates[:size], gates[size:]
        dh = (dh + d_seen[t]) * valid[t]
        da = dh * z * (1 - new * new)
        d_gates = np.concatenate((dh * (new - h), da * r)) * 2 * gates * (1 - gates)
        d_r = np.concatenate((d_gates, da * g))
        np.add.at(d_table, bytes_[t], np.concatenate((d_gates, da)).T)
        d_state += d_r @ h.T
        dh = dh * (1 - z) + net.state[way].T @ d_r
    return d_table.T, d_state


def gradients(
    net: ByteNetwork, bytes_: np.ndarray, valid: np.ndarray, target: np.ndarray
) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log-loss of all valid positions and its gradients."""
    size = net.state.shape[2]
    seen = net.states(bytes_, valid, 0), net.states(bytes_, valid, 1)
    both = np.concatenate(seen, axis=1)
    ds = np.stack([net.labels(seen, t) for t in range(len(bytes_))])
    lane = np.arange(bytes_.shape[1])
    count = max(1, valid.sum())
    loss = -float((np.log(np.maximum(ds[:, target, lane], 1e-30)) * valid).sum()) / count
    ds[:, target, lane] -= 1
    ds *= (valid / count)[:, None, :].astype(np.float32)
    d_both = np.matmul(net.out.T, ds)
    parts = [
        _backward(net, bytes_, valid, way, seen[way], d_both[:, way * size : (way + 1) * size]) for way in (0, 1)
    ]
    return loss, {
        "out": np.einsum("tkb,thb->kh", ds, both, optimize=True),
        "bias": ds.sum(axis=(0, 2)),
        "table": np.stack([x for x, _ in parts]),
        "state": np.stack([x for _, x in parts]),
    }


def fit_network(
    bytes_: np.ndarray,
    valid: np.ndarray,
    target: np.ndarray,
    languages: list[str],
    *,
    hidden: int = 12,
    epochs: int = 4,
    batch: int = 256,
    seed: int = 5,
) -> ByteNetwork:
    """Train on segments (steps, n) whose every position carries the language of its document."""
    one_blas_thread()
    rng = np.random.default_rng(seed)
    k = len(languages)
    net = ByteNetwork(
        languages,
        rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(2 * hidden), (k, 2 * hidden)).astype(np.float32),
        np.zeros(k, np.float32),
    )
    names = ("table", "state", "out", "bias")
    m = {x: np.zeros_like(getattr(net, x)) for x in names}
    v = {x: np.zeros_like(getattr(net, x)) for x in names}
    step, n = 0, bytes_.shape[1]
    total = epochs * -(-n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            pick = order[i : i + batch]
            b, ok, y = bytes_[:, pick], valid[:, pick], target[pick]
            _, grads = gradients(net, b, ok, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            rate = 0.02 * (1 - step / (total + 1)) + 0.001
            for x in names:
                g = grads[x] * min(1.0, 1.0 / max(norm, 1e-9))
                m[x] = 0.9 * m[x] + 0.1 * g
                v[x] = 0.999 * v[x] + 0.001 * g * g
                setattr(net, x, getattr(net, x) - rate * (m[x] / (1 - 0.9**step)) / (np.sqrt(v[x] / (1 - 0.999**step)) + 1e-8))
    return net


def fit_language(
    docs: DataFrame, train: Column, *, label: str = "lang", sample_rows: int = 4_000, sample_segments: int = 4
) -> ByteNetwork | None:
    """Fit on at most ``sample_rows`` documents with a language, ``sample_segments`` spread segments of each.

    The sample bounds training alone; None if no document has a language.
    """
    known = docs.where(F.col(label).isNotNull())
    names = sorted(r[0] for r in known.where(train).select(label).distinct().collect())
    if not names:
        return None
    number = F.array_position(F.array(*map(F.lit, names)), F.col(label)).cast("int") - 1
    labels = known.select("doc_id", number.alias("_number"))
    sample = labelled_sample(docs, labels, "_number", train, sample_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, starts, ends = text_bytes(batch.column("text"))
            a, b, owner = passages(starts, ends, SEGMENT)
            n = np.bincount(owner)[owner]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            take = (rank * sample_segments // n != (rank - 1) * sample_segments // n) & (b > a)
            y = batch.column("_label").to_numpy(zero_copy_only=False)[owner[take]]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[owner[take]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids),
                    pa.array(rank[take]),
                    pa.array(y.astype(np.int32)),
                    pa.array([held[i:j].tobytes() for i, j in zip(a[take], b[take], strict=True)], pa.binary()),
                ],
                names=["doc_id", "at", "label", "segment"],
            )

    kind = sample.schema["doc_id"].dataType.simpleString()
    # at most sample_rows * sample_segments short segments come to the driver
    rows = sorted(sample.mapInArrow(cut, f"doc_id {kind}, at bigint, label int, segment binary").collect())
    if not rows:
        return None
    held = np.frombuffer(b"".join(r["segment"] for r in rows), np.uint8)
    ends = np.cumsum([len(r["segment"]) for r in rows])
    bytes_, valid = _laid_out(held, np.concatenate(([0], ends[:-1])), ends)
    return fit_network(bytes_, valid, np.array([r["label"] for r in rows]), names)


def predict_language(docs: DataFrame, net: ByteNetwork | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of every whole text: key, ``lang_pred`` and ``score``.

    Every byte gets language probabilities; a document's are their mean, and
    its score the largest. Texts that are null or have no letter are ``und``
    with score 0, as are all texts without a network. One pass without shuffle;
    a task holds one batch of texts and runs ``LANES`` segments at a time.
    Repeated rows are judged each; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        own = sent.value
        for batch in batches:
            column = batch.column("_text")
            held, starts, ends = text_bytes(column)
            k = len(own.languages) if own else 1
            sums = np.zeros((len(starts), k))
            if own is not None and len(held):
                a, b, owner = passages(starts, ends, SEGMENT)
                for i in range(0, len(a), LANES):
                    bytes_, valid = _laid_out(held, a[i : i + LANES], b[i : i + LANES])
                    np.add.at(sums, owner[i : i + LANES], own.summed(bytes_, valid).T)
            mean = sums / np.maximum(1, ends - starts)[:, None]
            lettered = batch.column("_lettered").to_numpy(zero_copy_only=False).astype(bool)
            known = lettered & (own is not None)
            best = mean.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    pa.array([own.languages[x] if ok else "und" for x, ok in zip(best, known, strict=True)], pa.string()),
                    pa.array(np.where(known, np.minimum(1.0, mean.max(axis=1)), 0.0)),
                ],
                names=["_key", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col(key).alias("_key"),
        F.col(text).alias("_text"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_lettered"),
    )
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(predict, f"_key {kind}, lang_pred string, score double").withColumnRenamed("_key", key)
