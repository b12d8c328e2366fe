"""Repeated byte strings by an enhanced suffix array over anchored suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridegrid.llm.common import staged, trimmed

#: Contexts of one anchor that a task holds; anchors of more are counted window by window.
MOST_CONTEXTS = 200_000
#: Rows that are worked on together.
_TOGETHER = 20_000
#: Anchors whose surroundings are folded together.
_ANCHORS = 50_000
#: Spans that may be broadcast (16 bytes each).
BROADCAST_ITEMS = 4_000_000

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _sliding(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over every window of ``width``: running values from both ends of blocks of that width."""
    n = len(x)
    p = np.full(-(-n // width) * width, fill, x.dtype)
    p[:n] = x
    blocks = p.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints of the sampled half-length strings of a text.

    A string of half the length is an anchor if its fingerprint is the least
    in some window of ``length`` bytes, so every string of ``length`` bytes
    holds an anchor and equal strings hold equal ones at equal places.
    """
    k = length // 2
    width = length - k + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))
    g = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    g = (g ^ (g >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    g = (g ^ (g >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    g ^= g >> np.uint64(31)
    least = _sliding(g, width, np.minimum, np.iinfo(np.uint64).max)
    none = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((none, least, none)), width, np.maximum, 0) == g)
    return at, g[at]


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans (rows of start and end) as maximal runs."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.column_stack((spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]))


def _repeated_anchors(texts: DataFrame, length: int) -> DataFrame:
    """(tid, pos, hash) of anchors that occur more than once.

    An anchor that repeats within a batch of texts is known to repeat at once:
    its places are routed by text, and one witness goes to where its
    fingerprint is gathered, so a very frequent anchor is no large group.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tids, places, prints = [], [], []
            for tid, text in zip(batch.column("tid").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if text is None or tid in seen:
                    continue
                seen.add(tid)
                at, g = anchors(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), length)
                if len(at):
                    tids.append(np.full(len(at), tid, np.int64))
                    places.append(at)
                    prints.append(g.view(np.int64))
            if not tids:
                continue
            tid, pos, print_ = map(np.concatenate, (tids, places, prints))
            each, back, times = np.unique(print_, return_inverse=True, return_counts=True)
            known = times[back] > 1
            more = each[times > 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((np.where(known, tid, print_), more))),
                    pa.array(np.concatenate((print_, more))),
                    pa.array(np.concatenate((tid, np.zeros(len(more), np.int64)))),
                    pa.array(np.concatenate((pos, np.full(len(more), -1))).astype(np.int32)),
                    pa.array(np.concatenate((known, np.zeros(len(more), bool)))),
                ],
                names=["route", "hash", "tid", "pos", "known"],
            )

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # hash, tid, pos and whether its hash is known to repeat
        for batch in batches:
            h, tid, pos = (batch.column(x).to_numpy() for x in ("hash", "tid", "pos"))
            known = batch.column("known").to_numpy(zero_copy_only=False)
            out = [(tid[known], pos[known], h[known])]
            h, tid, pos = h[~known], tid[~known], pos[~known]
            if len(h):
                carried = last is not None
                if carried:
                    h, tid, pos = (np.concatenate(([x], y)) for x, y in zip(last[:3], (h, tid, pos), strict=True))
                fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (tid[1:] != tid[:-1]) | (pos[1:] != pos[:-1])))
                group = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
                many = np.bincount(group, weights=fresh + (pos < 0)) > 1
                if carried and last[3]:
                    many[0] = True
                keep = fresh & many[group] & (pos >= 0)
                if carried and last[3]:
                    keep[0] = False
                out.append((tid[keep], pos[keep], h[keep]))
                last = (h[-1], tid[-1], pos[-1], bool(many[-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["tid", "pos", "hash"]
            )

    rows = texts.mapInArrow(trimmed(sample), "route bigint, hash bigint, tid bigint, pos int, known boolean")
    rows = rows.repartition("route").sortWithinPartitions("known", "hash", "tid", "pos")
    return rows.mapInArrow(trimmed(repeated), "tid bigint, pos int, hash bigint")


_CONTEXTS = "route bigint, hash bigint, tid bigint, pos int, before binary, after binary, until int"


def _contexts(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """What stands around every repeated anchor: up to length - k bytes on both sides, the left ones reversed.

    Places of some texts with equal surroundings are repeats as they are: one of
    them goes on, and all their bytes are given out as spans (``until`` set).
    """
    k = length // 2
    side = length - k

    def folded(tids: list[int], texts: list[str], pos: np.ndarray, h: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        first: dict[tuple[int, bytes, bytes], list] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        for i, (tid, text) in enumerate(zip(tids, texts, strict=True)):
            data = text.encode("utf-8", "surrogatepass")
            turned, n = data[::-1], len(data)
            own = slice(ends[i], ends[i + 1])
            for p, x in zip(pos[own].tolist(), h[own].tolist(), strict=True):
                key = (x, turned[n - p : n - p + side], data[p + k : p + length])
                if (one := first.get(key)) is None:
                    first[key] = [tid, p, False]
                    continue
                if not one[2]:
                    one[2] = True
                    spans.setdefault(one[0], []).append((one[1] - len(key[1]), one[1] + k + len(key[2])))
                spans.setdefault(tid, []).append((p - len(key[1]), p + k + len(key[2])))
        keys = list(first)
        runs = [(tid, a, b) for tid, x in spans.items() for a, b in merged(np.array(x)).tolist() if b - a >= length]
        m, s = len(keys), len(runs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in keys] + [x[0] for x in runs], pa.int64()),
                pa.array([x[0] for x in keys] + [0] * s, pa.int64()),
                pa.array([first[x][0] for x in keys] + [x[0] for x in runs], pa.int64()),
                pa.array([first[x][1] for x in keys] + [x[1] for x in runs], pa.int32()),
                pa.array([x[1] for x in keys] + [None] * s, pa.binary()),
                pa.array([x[2] for x in keys] + [None] * s, pa.binary()),
                pa.array([None] * m + [x[2] for x in runs], pa.int32()),
            ],
            names=["route", "hash", "tid", "pos", "before", "after", "until"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = batch.column("at")
            ends = at.offsets.to_numpy()
            pos, h = (at.values.field(x).to_numpy() for x in ("pos", "hash"))
            tid = batch.column("tid").to_pylist()
            # texts with about _ANCHORS anchors are folded together
            group = (ends[:-1] - ends[0]) // _ANCHORS
            for a, b in _slices(group):
                take = [i for i in range(a, b) if not (tid[i] in seen or seen.add(tid[i]))]
                texts = [batch.column("_text")[i].as_py() for i in take]
                each = [np.arange(ends[i], ends[i + 1]) for i in take]
                where = np.concatenate(each) if each else np.zeros(0, np.int64)
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
                yield folded([tid[i] for i in take], texts, pos[where], h[where], bounds)

    per_text = found.groupBy("tid").agg(F.collect_list(F.struct("pos", "hash")).alias("at"))
    return texts.join(per_text, "tid").mapInArrow(trimmed(cut), _CONTEXTS)


def _matrix(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in column], np.int64)
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in column), np.uint8).reshape(-1, width), size


def _common(m: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows i and j."""
    differ = m[i] != m[j]
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(at, np.minimum(size[i], size[j]))


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval, inner ones first, by one scan with a stack.

    ``lcp[i]`` is the common prefix of entries i and i + 1.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeat_groups(
    before: list[bytes], after: list[bytes], edges: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of the anchors of several groups.

    Rows lie in suffix order (by ``after``) within groups of one anchor that
    start at ``edges``; ``before`` is reversed. Every common-prefix interval is
    one right extension; where its occurrences differ on the left, each is
    extended to the left as far as another occurrence agrees, and given out if
    that makes ``length`` bytes and more than an inner interval gave it.

    Returns row, repeat (the first row of its interval), bytes to the left and
    bytes to the right of the anchor.
    """
    side = length - length // 2
    right, right_size = _matrix(after, side)
    left, left_size = _matrix(before, side)
    n = len(after)
    ends = np.append(edges[1:], n)
    index = np.arange(n - 1)
    lcp = _common(right, right_size, index, index + 1) if n > 1 else np.zeros(0, np.int64)
    rows, names, lefts, rights = [], [], [], []
    two = edges[ends - edges == 2]
    lcs = _common(left, left_size, two, two + 1)
    hit = lcs + lcp[two] >= side if len(two) else np.zeros(0, bool)
    for d in (0, 1):
        rows.append(two[hit] + d)
        names.append(two[hit])
        lefts.append(lcs[hit])
        rights.append(lcp[two[hit]] if len(two) else lcs[hit])
    for a, b in zip(edges[ends - edges > 2].tolist(), ends[ends - edges > 2].tolist(), strict=True):
        own = [before[i] for i in range(a, b)]
        by_left = np.array(sorted(range(b - a), key=own.__getitem__))
        rank = np.empty(b - a, np.int64)
        rank[by_left] = np.arange(b - a)
        best = np.full(b - a, -1)
        for depth, first, last in intervals(lcp[a : b - 1].tolist()):
            members = first + np.argsort(rank[first : last + 1], kind="stable")
            near = _common(left, left_size, a + members[:-1], a + members[1:])
            reach = np.maximum(np.concatenate(([-1], near)), np.concatenate((near, [-1])))
            new = (reach + depth >= side) & (reach > best[members])
            if new.any():
                got = members[new]
                best[got] = reach[new]
                rows.append(a + got)
                names.append(np.full(len(got), a + first))
                lefts.append(reach[new])
                rights.append(np.full(len(got), depth))
    return tuple(np.concatenate(x).astype(np.int64) for x in (rows, names, lefts, rights))


_REPEATS = "repeat bigint, tid bigint, start int, end int, hash bigint, before binary, after binary"


def repeats(texts: DataFrame, *, length: int = 200, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """Maximal repeats: (repeat, tid, start, end) for all occurrences of strings of ``length`` bytes and more.

    ``texts``: tid (a fingerprint of the text) and _text; equal texts count
    once. An occurrence is cut where it reaches ``length - k`` bytes beyond its
    anchor; longer repeats have several anchors. Bytes are covered by these
    occurrences exactly if a string of ``length`` bytes around them also starts
    elsewhere in the different texts.
    """
    k = length // 2
    side = length - k

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of whole anchors
        current: list[tuple] = []  # rows of the anchor that goes on
        large = False

        def out(rows: list[tuple], overflow: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 4
            over = list(zip(*overflow, strict=True)) or [()] * 5
            m, s = len(rows), len(overflow)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*cols[0], *[None] * s], pa.int64()),
                    pa.array([*cols[1], *over[1]], pa.int64()),
                    pa.array([*cols[2], *over[2]], pa.int32()),
                    pa.array([*cols[3], *[None] * s], pa.int32()),
                    pa.array([*[None] * m, *over[0]], pa.int64()),
                    pa.array([*[None] * m, *over[3]], pa.binary()),
                    pa.array([*[None] * m, *over[4]], pa.binary()),
                ],
                names=["repeat", "tid", "start", "end", "hash", "before", "after"],
            )

        def solved() -> list[tuple]:
            if not held:
                return []
            h = np.array([r[0] for r in held])
            edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            found = repeat_groups([r[3] for r in held], [r[4] for r in held], edges, length)
            made = [
                (held[q][0] ^ (held[q][1] + held[q][2]), held[i][1], held[i][2] - a, held[i][2] + k + b)
                for i, q, a, b in zip(*(x.tolist() for x in found), strict=True)
            ]
            held.clear()
            return made

        for batch in batches:
            direct: list[tuple] = []
            overflow: list[tuple] = []
            rows = zip(
                *(batch.column(x).to_pylist() for x in ("hash", "tid", "pos", "before", "after", "until")), strict=True
            )
            for row in rows:
                if row[5] is not None:
                    direct.append((row[1], row[1], row[2], row[5]))
                    continue
                if current and current[0][0] != row[0]:
                    if large:
                        overflow += current
                    elif len(current) > 1:
                        held.extend(current)
                    current, large = [], False
                    if len(held) >= _TOGETHER:
                        direct += solved()
                current.append(row[:5])
                if len(current) >= most_contexts:
                    overflow += current[:-1]
                    del current[:-1]
                    large = True
            yield out(direct, overflow)
        if not large and len(current) > 1:
            held.extend(current)
        yield out(solved(), current if large else [])

    found = _contexts(texts, _repeated_anchors(texts, length), length)
    order = found.repartition("route").sortWithinPartitions("hash", "after", "before", "tid", "pos")
    given = staged(order.mapInArrow(trimmed(solve), _REPEATS), "repeats")
    small_ones = given.where("end IS NOT NULL").select("repeat", "tid", "start", "end")
    # Anchors with very many surroundings: each string of the length that holds the anchor is counted by its fingerprint.
    many = given.where("end IS NULL").select("tid", F.col("start").alias("pos"), "hash", "before", "after")
    left, right = F.octet_length("before"), F.octet_length("after")
    offset = F.explode(F.sequence(F.greatest(F.lit(0), side - right), F.least(F.lit(side), left)))
    windows = (
        many.where(left + right >= side)
        .withColumn("o", offset)
        .withColumn("w", F.xxhash64("hash", "o", F.substring("before", F.lit(1), F.col("o")), F.substring("after", F.lit(1), side - F.col("o"))))
        .select("tid", "pos", "o", "w")
    )
    twice = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    large_ones = windows.join(twice, "w").select(
        F.col("w").alias("repeat"),
        "tid",
        (F.col("pos") - F.col("o")).cast("int").alias("start"),
        (F.col("pos") - F.col("o") + length).cast("int").alias("end"),
    )
    return small_ones.union(large_ones)


def repeat_spans(texts: DataFrame, *, length: int = 200, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(tid, spans): the union of all repeats in each different text, as maximal runs."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tid, spans = None, []
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def out(rows: list[tuple[int, list]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([t for t, _ in rows], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in merged(np.array(s)).tolist()] for _, s in rows], kind),
                ],
                names=["tid", "spans"],
            )

        for batch in batches:
            done = []
            t, a, b = (batch.column(x).to_numpy() for x in ("tid", "start", "end"))
            for edge, stop in _slices(t):
                if t[edge] != tid:
                    if spans:
                        done.append((tid, spans))
                    tid, spans = int(t[edge]), []
                part = merged(np.column_stack((a[edge:stop], b[edge:stop])))
                spans = merged(np.concatenate((np.array(spans).reshape(-1, 2), part)).astype(np.int64)).tolist()
            yield out(done)
        if spans:
            yield out([(tid, spans)])

    rows = repeats(texts, length=length, most_contexts=most_contexts).select("tid", "start", "end")
    rows = rows.repartition("tid").sortWithinPartitions("tid", "start")
    return rows.mapInArrow(trimmed(join), "tid bigint, spans array<struct<start:int,end:int>>")


def _slices(x: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(x):
        edges = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))).tolist()
        yield from zip(edges[:-1], edges[1:], strict=True)


def remove_repeats(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    length: int = 200,
    most_contexts: int = MOST_CONTEXTS,
) -> DataFrame:
    """Texts without the bytes of any string of ``length`` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; strings never cross texts; the same text counts as
    elsewhere, and strings are judged on the input. Equal texts are found by
    their fingerprint (64 bits) and are repeats as a whole. All other repeats
    come from anchors: sampled half-length strings that occur more than once,
    whose surroundings are sorted into a suffix array per anchor (see
    ``repeat_groups``). Anchors with more than ``most_contexts`` different
    surroundings are resolved by counting windows, so no group is held whole.

    Returns a row per document: key, ``n_bytes``, ``n_removed``, ``spans``
    (maximal removed runs, in bytes) and ``kept`` (the remaining bytes). Null
    texts are empty; repeated rows are copies of each other; other columns are
    not read.
    """
    rows = docs.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tid")
    )
    texts = rows.select("tid", "_text").where(F.octet_length("_text") >= length)
    copied = texts.groupBy("tid").agg(F.count("*").alias("n"), F.max(F.octet_length("_text")).alias("size"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end")))
    copied = staged(copied.where("n > 1").select("tid", whole.alias("all")), "copied")
    found = repeat_spans(texts, length=length, most_contexts=most_contexts)
    spans = copied.join(found, "tid", "full_outer").select("tid", F.coalesce("all", "spans").alias("spans"))
    spans = staged(spans, "spans")
    if (spans.agg(F.sum(1 + F.size("spans"))).first()[0] or 0) <= BROADCAST_ITEMS:
        spans = F.broadcast(spans)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size = [], []
            for body, runs in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = (body or "").encode("utf-8", "surrogatepass")
                size.append(len(data))
                at, parts = 0, []
                for r in runs or ():
                    parts.append(data[at : r["start"]])
                    at = r["end"]
                kept.append(b"".join([*parts, data[at:]]) if runs else data)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    pa.array(size, pa.int64()),
                    pa.array([n - len(x) for n, x in zip(size, kept, strict=True)], pa.int64()),
                    batch.column("spans"),
                    pa.array(kept, pa.binary()),
                ],
                names=["_key", "n_bytes", "n_removed", "spans", "kept"],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    shape = f"_key {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept binary"
    out = rows.join(spans, "tid", "left").select("_key", "_text", "spans").mapInArrow(trimmed(drop), shape)
    return out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).withColumnRenamed(
        "_key", key
    )
