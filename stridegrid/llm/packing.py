"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stridegrid.llm.common import small, staged

#: Queues of the outer schedule; sources beyond have theirs in schedules nested in one more.
QUEUES = 255
#: Queues of a nested schedule, about.
_FAN = 256
#: Rounds that are looked at together, and nested schedules that a worker holds.
_ROUNDS, _PLANS = 8192, 512
#: Weights of the queues served in a round add up to 2**WEIGHT_BITS.
WEIGHT_BITS = 20
#: Entries of a generation of the word table of a worker; two generations are held.
_WORDS = 500_000
#: Texts that are split at a time.
_TEXTS = 500


class _Aging:
    """A table of two generations: what was not asked for since the last change goes with the next one."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def age(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that are not known; all others are in the young generation from now on."""
        young, old = self.young, self.old
        absent = {x for x in keys if x not in young}
        kept = [x for x in absent if x in old]
        for key in kept:
            young[key] = old[key]
        return absent.difference(kept)


class WordCache:
    """Token ids of texts, word by word.

    The tokenizer lowers case, splits at white space and between letters and
    punctuation, so ids of a word do not depend on what stands around it. Words
    are looked up in a table of bounded size; what is missing is encoded
    together. Texts with characters whose reading may depend on more than the
    word are encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words = _Aging(_WORDS)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _split(self, text: str) -> list[str] | None:
        """Words of a text; None if it must be encoded whole."""
        if any(x in text for x in "\x1c\x1d\x1e\x1fΣİ"):
            return None
        low = text.lower()
        return None if any(x in low for x in self.special) else low.split()

    def _encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words; those of letters alone are one pre-token each and are encoded as a line."""
        lines = [w for w in words if w.isalpha() and unicodedata.is_normalized("NFC", w)]
        for i in range(0, len(lines), 1000):
            part = lines[i : i + 1000]
            line = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            word = np.array(line.word_ids)
            if len(word) and word[-1] + 1 != len(part):
                yield from ((w, self._plain(w)) for w in part)
                continue
            at = np.searchsorted(word, np.arange(len(part) + 1))
            ids = np.array(line.ids, self.dtype)
            yield from ((w, ids[a:b].tobytes()) for w, a, b in zip(part, at[:-1], at[1:], strict=True))
        rest = set(words).difference(lines)
        yield from ((w, self._plain(w)) for w in rest)

    def _learn(self, words: set[str]) -> None:
        missing = self.words.missing(words)
        parts: dict[str, tuple[str, str]] = {}
        new = set()
        for chunk in missing:
            if chunk.isalpha():
                new.add(chunk)
                continue
            word = chunk.rstrip(string.punctuation)
            if word and len(word) < len(chunk) and word[-1].isalnum() and "'" not in chunk:
                parts[chunk] = word, chunk[len(word) :]
            else:
                new.add(chunk)
        pieces = {x for pair in parts.values() for x in pair} - new
        new |= self.words.missing(pieces) if pieces else pieces
        known = self.words.young
        known.update(self._encode_words(list(new)))
        for chunk, (word, tail) in parts.items():
            known[chunk] = known[word] + known[tail]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of texts as packed unsigned numbers of ``dtype``."""
        out: list[bytes] = []
        for i in range(0, len(texts), _TEXTS):
            part = [x or "" for x in texts[i : i + _TEXTS]]
            split = [self._split(x) for x in part]
            self.words.age()
            self._learn(set().union(*(x for x in split if x)))
            ids = self.words.young.__getitem__
            out += [
                self._plain(text) if words is None else b"".join(map(ids, words))
                for text, words in zip(part, split, strict=True)
            ]
        return out

    def ids(self, text: str | None) -> bytes:
        """Token ids of one text."""
        return self.many([text])[0]


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """The cache of this worker process."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


@dataclass
class Phase:
    """Rounds in which the same queues are served.

    ``at``: tokens given before; ``given``: of each queue; ``left``: what each
    queue still has; ``weight``: credit a round in 2**-shift tokens; ``credit``:
    the deficit carried in.
    """

    at: int
    given: np.ndarray
    left: np.ndarray
    weight: np.ndarray
    credit: np.ndarray
    shift: int

    def served(self, rounds: np.ndarray, queue: int | None = None) -> np.ndarray:
        """Tokens given to each queue (or one) after so many rounds of this phase."""
        if queue is not None:
            return np.minimum(self.left[queue], (self.credit[queue] + rounds * self.weight[queue]) >> self.shift)
        got = (self.credit[None, :] + rounds[:, None] * self.weight[None, :]) >> self.shift
        return np.minimum(self.left[None, :], got)


def schedule(totals: Sequence[int], weights: Sequence[float], window: int) -> list[Phase]:
    """Deficit round-robin in closed form.

    A round credits every queue that is not empty with its share of ``window``
    tokens, and the queue gives as many whole tokens as its credit allows; the
    fraction stays as its deficit. So the tokens given after any number of
    rounds follow from that number alone, and any task can find where a token
    goes. When a queue runs empty a new phase shares its part among the others.
    """
    total = np.array(totals, np.int64)
    wish = np.array(weights, np.float64)
    shift = WEIGHT_BITS - int(window).bit_length() + 1
    if window != 1 << (window.bit_length() - 1) or shift < 0:
        raise ValueError("the window must be a power of two")
    given = np.zeros(len(total), np.int64)
    credit = np.zeros(len(total), np.int64)
    out: list[Phase] = []
    while (left := total - given).any():
        live = np.flatnonzero(left)
        share = wish[live] / wish[live].sum() * (1 << WEIGHT_BITS)
        weight = np.zeros(len(total), np.int64)
        weight[live] = np.maximum(1, np.floor(share)).astype(np.int64)
        weight[live[np.argmax(share)]] += (1 << WEIGHT_BITS) - weight.sum()
        phase = Phase(int(given.sum()), given.copy(), left, weight, np.where(left > 0, credit, 0), shift)
        out.append(phase)
        need = -(-((left[live] << shift) - phase.credit[live]) // weight[live])
        rounds = int(need.min())
        got = phase.served(np.array([rounds]))[0]
        credit = (phase.credit + rounds * weight) - (got << shift)
        credit = np.where(got < left, credit, 0)
        given = given + got
    return out


def pieces_of(
    phases: list[Phase], queue: int, start: np.ndarray, size: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens [start, start + size) of a queue go, for many documents at once.

    Returns the document, first token, length and global position of every run
    of tokens that one round gives.
    """
    rows, starts, lengths, places = [], [], [], []
    end = start + size
    if not len(start):
        phases = []
    for i, phase in enumerate(phases):
        low = int(phase.given[queue])
        if low >= end.max():
            break
        high = int(phases[i + 1].given[queue]) if i + 1 < len(phases) else low + int(phase.left[queue])
        a, b = np.maximum(start, low) - low, np.minimum(end, high) - low
        here = np.flatnonzero(a < b)
        if not len(here):
            continue
        a, b = a[here], b[here]
        w, c = int(phase.weight[queue]), int(phase.credit[queue])
        once = w < 1 << phase.shift  # a round gives at most one token: only rounds that give one count
        first = a if once else -(-(((a + 1) << phase.shift) - c) // w)
        count = b - a if once else -(-((b << phase.shift) - c) // w) - first + 1
        until = np.cumsum(count)
        for at in range(0, int(until[-1]), _ROUNDS):
            nth = np.arange(at, min(at + _ROUNDS, int(until[-1])))
            row = np.searchsorted(until, nth, side="right")
            rounds = first[row] + nth - (until - count)[row]
            if once:
                rounds = -(-(((rounds + 1) << phase.shift) - c) // w)
            before, after = phase.served(rounds - 1), phase.served(rounds)
            own = before[:, queue]
            s, e = np.maximum(a[row], own), np.minimum(b[row], after[:, queue])
            place = phase.at + before.sum(axis=1) + (after[:, :queue] - before[:, :queue]).sum(axis=1) + (s - own)
            keep = e > s
            rows.append(here[row[keep]])
            starts.append(s[keep] + low)
            lengths.append((e - s)[keep])
            places.append(place[keep])
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(none + x) for x in (rows, starts, lengths, places))


@dataclass
class Nested:
    """Schedules of the sources beyond the outer queues, nested in one queue.

    Sources stand in groups of about ``fan``, groups in groups of that many
    groups, up to one. A group is a schedule like the outer one, of its members
    by size; a round of it has about the tokens it is given in a window, or a
    quarter of them where groups stand in groups, so that a window has whole
    rounds of the lowest too.
    ``totals``: of the sources, by group; ``bounds``: where groups begin in
    ``totals``; ``levels``: totals of the groups of each level, lowest first.
    """

    totals: np.ndarray
    bounds: np.ndarray
    levels: list[np.ndarray]
    window: float
    fan: int

    @classmethod
    def of(cls, group: np.ndarray, totals: np.ndarray, groups: int, window: float, fan: int = _FAN) -> Nested:
        """``group`` is ascending."""
        bounds = np.searchsorted(group, np.arange(groups + 1))
        sums = np.concatenate(([0], np.cumsum(totals)))
        levels = [sums[bounds[1:]] - sums[bounds[:-1]]]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append(np.add.reduceat(below, np.arange(0, len(below), fan)))
        return cls(totals, bounds, levels, window if len(levels) == 1 else window / 4, fan)

    def plan(self, level: int, group: int, made: dict) -> list[Phase]:
        """The schedule of a group; ``made`` holds some of them."""
        if (level, group) not in made:
            if len(made) >= _PLANS:
                made.clear()
            if level:
                below = self.levels[level - 1][group * self.fan : (group + 1) * self.fan]
            else:
                below = self.totals[self.bounds[group] : self.bounds[group + 1]]
            given = self.window * self.levels[level][group] / self.levels[-1][0]
            made[level, group] = schedule(below, below, 1 << (max(1, int(given)).bit_length() - 1))
        return made[level, group]

    def pieces(
        self, group: np.ndarray, member: np.ndarray, start: np.ndarray, size: np.ndarray, made: dict
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``pieces_of``, with places in the queue that all of them share."""
        doc, begin, length, place = np.arange(len(start)), start, size, start
        for level in range(len(self.levels)):
            order = np.lexsort((member, group))
            cuts = np.flatnonzero(np.diff(group[order]) | np.diff(member[order])) + 1
            parts = []
            for own in np.split(order, cuts) if len(order) else []:
                phases = self.plan(level, int(group[own[0]]), made)
                run, s, k, g = pieces_of(phases, int(member[own[0]]), place[own], length[own])
                run = own[run]
                parts.append((doc[run], begin[run] + s - place[run], k, g, group[run]))
            none = [(np.zeros(0, np.int64),) * 5]
            doc, begin, length, place, group = (np.concatenate(x) for x in zip(*(none + parts), strict=True))
            group, member = group // self.fan, group % self.fan
        return doc, begin, length, place


def windowed(place: np.ndarray, length: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut at the ends of sequences: the run of every piece, its place and length; ``edges``: ends, ascending."""
    stop = edges[np.searchsorted(edges, place, side="right")]
    run, at, size = [np.arange(len(place))], [place], [np.minimum(length, stop - place)]
    while True:
        left = length[run[-1]] - (at[-1] + size[-1] - place[run[-1]])
        more = left > 0
        if not more.any():
            break
        run.append(run[-1][more])
        at.append((at[-1] + size[-1])[more])
        stop = edges[np.searchsorted(edges, at[-1], side="right")]
        size.append(np.minimum(left[more], stop - at[-1]))
    return np.concatenate(run), np.concatenate(at), np.concatenate(size)


def tail_edges(total: int, window: int) -> list[int]:
    """Ends of the sequences after the last full window: descending powers of two, so nothing is padded."""
    at, out = total // window * window, []
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        out.append(at)
    return out


def token_table(
    docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", source: str = "source", end_id: int = 2
) -> DataFrame:
    """Token ids of every document, written once.

    key, source (null is empty), ``part`` (the task that read it), ``before``
    (tokens of the same source and part ahead of it), ``n``, ``ids`` (packed).
    A null text is empty; every document ends with ``end_id``.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer)
        end = np.array([end_id], cache.dtype).tobytes()
        part = TaskContext.get().partitionId()
        counts: dict[str, int] = {}
        for batch in batches:
            sources = batch.column("source").to_pylist()
            ids = [x + end for x in cache.many(batch.column("_text").to_pylist())]
            n, before = [], []
            for s, x in zip(sources, ids, strict=True):
                n.append(len(x) // cache.dtype.itemsize)
                before.append(counts.get(s, 0))
                counts[s] = before[-1] + n[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    batch.column("source"),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(before, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["_key", "source", "part", "before", "n", "ids"],
            )

    rows = docs.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(text).alias("_text"),
    )
    kind = rows.schema["_key"].dataType.simpleString()
    shape = f"_key {kind}, source string, part int, before bigint, n bigint, ids binary"
    return staged(rows.mapInArrow(encode, shape), "tokens")


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    window: int = 4096,
    end_id: int = 2,
    targets: dict[str, float] | None = None,
    queues: int = QUEUES,
    fan: int = _FAN,
) -> DataFrame:
    """Pack every token of every document into sequences of ``window`` tokens.

    Each source is a queue; deficit round-robin fills every window with the
    proportions ``targets`` (sources not named share what is left by size; by
    default each source's share of all tokens), as long as its queue lasts, and
    carries the deficits over windows, partitions and tasks: the schedule is a
    closed form of the totals. The ``queues`` largest sources and those named in
    ``targets`` are queues of the outer schedule; all others are queues of
    schedules of about ``fan`` nested in one more (``Nested``). Only the total of every source
    is gathered, in 20 bytes each. Tokens after the last full window form
    sequences of powers of two; nothing is padded.

    Returns a row per piece: key, ``start``, ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``ids`` (little-endian unsigned 32-bit).
    Null and empty texts are documents of one id; repeated rows are packed
    each; an empty table gives no piece; other columns are not read.
    """
    tokens = token_table(docs, tokenizer, key=key, text=text, source=source, end_id=end_id)
    by_part = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    by_part = staged(by_part, "token-counts")
    sizes = staged(by_part.groupBy("source").agg(F.sum("n").alias("n")), "source-sizes")
    spark = docs.sparkSession
    named = sizes.orderBy(F.desc("n"), "source").limit(queues).collect()
    if targets:
        asked = spark.createDataFrame([(s,) for s in targets], "source string")
        have = {r["source"] for r in named}
        named += sorted(r for r in sizes.join(F.broadcast(asked), "source", "left_semi").collect() if r["source"] not in have)
    number = spark.createDataFrame([(r["source"], i) for i, r in enumerate(named)], "source string, queue int")
    rest = (sizes.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in named)
    totals = [r["n"] for r in named] + [rest]
    total = sum(totals)
    wish = [float(n) for n in totals]
    if targets is not None:
        known = {r["source"]: i for i, r in enumerate(named)}
        fixed = {known[s]: p for s, p in targets.items() if s in known}
        free = total - sum(totals[i] for i in fixed)
        left = max(0.0, 1.0 - sum(fixed.values()))
        wish = [fixed[i] if i in fixed else left * n / max(1, free) for i, n in enumerate(totals)]
        wish = [max(w, 1e-9) for w in wish]
    phases = schedule(totals, wish, window) if total else []
    edges = tail_edges(total, window)
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_part.select("source", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    offsets = offsets.join(F.broadcast(number), "source", "left")
    nested = None
    if rest:
        others = sizes.join(F.broadcast(number), "source", "left_anti")
        groups = -(-(sizes.count() - len(named)) // fan)
        others = others.withColumn("group", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int"))
        member = F.row_number().over(W.partitionBy("group").orderBy("source")) - 1
        others = staged(others.withColumn("member", member), "nested-queues")
        table = others.select("group", "member", "n").toArrow()
        group, member, n = (table.column(x).to_numpy().astype(np.int64) for x in ("group", "member", "n"))
        order = np.lexsort((member, group))
        nested = Nested.of(group[order], n[order], groups, window * wish[-1] / sum(wish), fan)
        offsets = offsets.join(small(others.select("source", "group", "member")), "source", "left")
    else:
        offsets = offsets.withColumn("group", F.lit(0)).withColumn("member", F.lit(0))
    offsets = offsets.fillna({"queue": len(named), "group": 0, "member": 0})
    placed = tokens.join(small(staged(offsets, "queue-offsets")), ["source", "part"])
    plan = spark.sparkContext.broadcast((phases, edges, nested))
    last = len(named)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = word_cache(tokenizer).dtype
        own_phases, own_edges, own_nested = plan.value
        made: dict = {}
        full = total // window * window
        for batch in batches:
            keys = batch.column("_key")
            queue, group, member, base, before, n = (
                batch.column(x).to_numpy().astype(np.int64) for x in ("queue", "group", "member", "base", "before", "n")
            )
            at = base + before
            docs_, starts, lengths, places = [], [], [], []
            for q in np.unique(queue).tolist():
                own = np.flatnonzero(queue == q)
                if q < last:
                    doc, s, k, g = pieces_of(own_phases, q, at[own], n[own])
                else:
                    inner, begun, size, place = own_nested.pieces(group[own], member[own], at[own], n[own], made)
                    run, s, k, g = pieces_of(own_phases, q, place, size)
                    doc, s = inner[run], begun[run] + s - place[run]
                docs_.append(own[doc])
                starts.append(s - at[own[doc]])
                lengths.append(k)
                places.append(g)
            doc, begin, size, g = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (docs_, starts, lengths, places))
            # ends of the sequences that this batch touches
            low, high = (g.min() // window, (g + size).max() // window + 1) if len(g) else (0, 0)
            ends = np.arange(low + 1, min(high, total // window) + 1, dtype=np.int64) * window
            ends = np.unique(np.concatenate((ends, np.array([*own_edges, total // window * window], np.int64))))
            run, position, length = windowed(g, size, ends)
            row, start = doc[run], begin[run] + (position - g[run])
            packed = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in batch.column("ids").to_pylist()]
            out = [
                packed[i][4 * a : 4 * (a + m)] for i, a, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)
            ]
            whole = n[row]
            borders = np.array([full, *own_edges], np.int64)
            late = np.searchsorted(borders, position, side="right") - 1
            sequence = np.where(position < full, position // window, full // window + late)
            first = np.where(position < full, position // window * window, borders[np.maximum(late, 0)])
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(row, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(whole, pa.int64()),
                    pa.array(sequence, pa.int64()),
                    pa.array(position - first, pa.int64()),
                    pa.array(out, pa.binary()),
                ],
                names=["_key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    kind = tokens.schema["_key"].dataType.simpleString()
    shape = f"_key {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return placed.mapInArrow(cut, shape).withColumnRenamed("_key", key)
