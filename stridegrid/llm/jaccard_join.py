"""Near-duplicate texts by a prefix-tree join of their word n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridegrid.llm.common import small, staged, trimmed
from stridegrid.llm.components import components

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORDS_KEPT = 200_000
#: Buckets of the frequency sketch (2**bits) and of one of its chunks.
SKETCH_BITS, CHUNK_BITS = 22, 16
#: Shingles and sets of a block; a task joins two blocks at a time.
BLOCK_SHINGLES, BLOCK_SETS = 1_000_000, 2_000
#: Parts into which the sets of a very frequent shingle are dealt.
SALTS = 64
#: Rows of a run that are compared with all of its sets at once.
_STRIP = 64

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    """64-bit hashes of words, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _WORDS_KEPT:
            self[word] = value
        return value


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct 64-bit fingerprints of the word n-grams of a text, ascending.

    A-Z are lower-cased and words stand between ASCII white space. A text of
    fewer words, but not none, has its whole sequence as its one shingle.
    """
    held = [_HASHES[w] for w in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()]
    if not held:
        return np.zeros(0, np.uint64)
    h = np.array(held, np.uint64)
    size = min(words, len(h))
    count = len(h) - size + 1
    out = np.full(count, np.uint64(size), np.uint64)
    for k in range(size):
        out = _mix(out + h[k : k + count])
    return np.unique(out)


def set_id(found: np.ndarray) -> int:
    """A 64-bit fingerprint of a set; 0 for the empty set."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) >> 1 if len(found) else 0


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def in_order(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set in the global order: rare shingles first by the sketch, ties by fingerprint."""
    return found[np.argsort(levels[_bucket(found)], kind="stable")]


def prefix_size(n: int, percent: int) -> int:
    """Elements in order of which a partner of at least ``percent`` similarity must share one."""
    return n - -(-percent * n // 100) + 1


def needed(nx: int, ny: int, percent: int) -> int:
    """Least intersection of sets of these sizes that links them."""
    return -(-percent * (nx + ny) // (100 + percent))


def _set_rows(docs: DataFrame, words: int) -> DataFrame:
    """A row per document (key, tid, n, sid) and, per task, rows of the frequency sketch.

    Sketch rows count the buckets of the task's shingles, 255 at most each, one
    row per chunk: as pairs where few buckets are hit, else as an array.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        counts = np.zeros(1 << SKETCH_BITS, np.uint8)
        part = TaskContext.get().partitionId()
        for batch in batches:
            kind = batch.column("_key").type
            n, sids = [], []
            for text in batch.column("_text").to_pylist():
                found = shingles(text, words)
                n.append(len(found))
                sids.append(set_id(found))
                hit, times = np.unique(_bucket(found), return_counts=True)
                counts[hit] = np.minimum(255, counts[hit] + times).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    batch.column("_tid"),
                    pa.array(n, pa.int64()),
                    pa.array(sids, pa.int64()),
                    pa.nulls(len(n), pa.int32()),
                    pa.nulls(len(n), pa.int32()),
                    pa.nulls(len(n), pa.binary()),
                ],
                names=["_key", "tid", "n", "sid", "part", "chunk", "counts"],
            )
        if kind is None:
            return
        size = 1 << CHUNK_BITS
        held = [(c, counts[c * size : (c + 1) * size]) for c in range(len(counts) // size)]
        packed = [(c, _packed(x)) for c, x in held if x.any()]
        m = len(packed)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(m, kind),
                pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.int64()),
                pa.array([part] * m, pa.int32()),
                pa.array([c for c, _ in packed], pa.int32()),
                pa.array([x for _, x in packed], pa.binary()),
            ],
            names=["_key", "tid", "n", "sid", "part", "chunk", "counts"],
        )

    kind = docs.schema["_key"].dataType.simpleString()
    return docs.mapInArrow(trimmed(scan), f"_key {kind}, tid bigint, n bigint, sid bigint, part int, chunk int, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    hit = np.flatnonzero(counts)
    if 3 * len(hit) >= len(counts):
        return counts.tobytes()
    return hit.astype("<u2").tobytes() + counts[hit].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    size = 1 << CHUNK_BITS
    if len(data) == size:
        return np.frombuffer(data, np.uint8).astype(np.uint64)
    k = len(data) // 3
    out = np.zeros(size, np.uint64)
    out[np.frombuffer(data[: 2 * k], "<u2")] = np.frombuffer(data[2 * k :], np.uint8)
    return out


def _levels(rows: DataFrame, fan_in: int = 256) -> tuple[np.ndarray, float, float]:
    """The sketch of all tasks as one small number per bucket, its mean count and the scale of the numbers.

    Chunks of tasks are added ``fan_in`` at a time; the result has a fixed size
    (4 MB) and comes to the driver.
    """

    def add(table: pa.Table) -> pa.Table:
        wide = table.column("wide").to_pylist()
        total = np.zeros(1 << CHUNK_BITS, np.uint64)
        for is_wide, data in zip(wide, table.column("counts").to_pylist(), strict=True):
            total += np.frombuffer(data, np.uint64) if is_wide else _unpacked(data)
        return pa.table(
            [table.column("chunk").slice(0, 1), table.column("part").slice(0, 1), pa.array([True]), pa.array([total.tobytes()], pa.binary())],
            names=["chunk", "part", "wide", "counts"],
        )

    parts = rows.agg(F.max("part")).first()[0]
    counts = np.zeros(1 << SKETCH_BITS, np.float64)
    if parts is None:
        return counts.astype(np.uint8), 0.0, 8.0
    rows = rows.select("chunk", "part", F.lit(False).alias("wide"), "counts")
    while True:
        parts = int(parts) // fan_in
        rows = rows.withColumn("part", (F.col("part") / fan_in).cast("int")).groupBy("chunk", "part")
        rows = rows.applyInArrow(add, "chunk int, part int, wide boolean, counts binary")
        if not parts:
            break
    for r in rows.select("chunk", "counts").toLocalIterator():
        counts[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(r["counts"], np.uint64)
    scale = min(16.0, 250 / max(1.0, np.log2(counts.max() + 1)))
    known, size = np.empty(len(counts), np.uint8), 1 << CHUNK_BITS
    for i in range(0, len(counts), size):  # chunk by chunk: copies of the whole would weigh 32 MB each on the driver
        known[i : i + size] = np.floor(scale * np.log2(counts[i : i + size] + 1)).astype(np.uint8)
    return known, float(counts.mean()), scale


def _prefix_rows(docs: DataFrame, levels: Broadcast, hot_level: int, words: int, percent: int) -> DataFrame:
    """(token, sid, meta) for the prefix of every set, once per task.

    ``meta`` packs the set size, the place of the token and whether it is hot,
    so that it sorts by size.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = levels.value
        seen: set[int] = set()
        for batch in batches:
            tokens, sids, sizes = [], [], []
            for text in batch.column("_text").to_pylist():
                found = shingles(text, words)
                sid = set_id(found)
                if not sid or sid in seen:
                    continue
                seen.add(sid)
                tokens.append(in_order(found, order)[: prefix_size(len(found), percent)])
                sids.append(sid)
                sizes.append(len(found))
            if not tokens:
                continue
            each = np.array([len(x) for x in tokens])
            token = np.concatenate(tokens)
            place = np.arange(len(token)) - np.repeat(np.cumsum(each) - each, each)
            hot = order[_bucket(token)] >= hot_level
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(token.view(np.int64)),
                    pa.array(np.repeat(np.array(sids, np.int64), each)),
                    pa.array((np.repeat(np.array(sizes, np.int64), each) << 32) | (place << 1) | hot),
                ],
                names=["token", "sid", "meta"],
            )

    return docs.select("_text").mapInArrow(trimmed(prefixes), "token bigint, sid bigint, meta bigint")


def _runs(prefix: DataFrame, percent: int) -> DataFrame:
    """(token, sid, n, lead): sets that may link with another set of the same prefix token.

    Sets of a token stand in order of size; a run ends where the next set is
    too large for any set before it, and ``lead`` is its first set. If a link's
    first common token is this one, what follows it in both sets must hold the
    needed overlap: a set of size n with r elements from the token on can link
    with sizes up to ``cap`` = r * (100 + percent) / percent - n, and with a
    smaller set only if that set's cap reaches n. Other sets are left out of the
    run. Tokens of a very high count are dealt to several tasks, each with leads
    of its own, and keep all their sets.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        carry = (none, none, none, none, none)  # the last row, its lead and the largest cap before it

        def out(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "sid", "n", "lead"])

        for batch in batches:
            rows = (batch.column(x).to_numpy() for x in ("token", "sid", "meta"))
            token, sid, meta = (np.concatenate(x) for x in zip(carry[:3], rows, strict=True))
            if not len(token):
                continue
            fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])))
            token, sid, meta = token[fresh], sid[fresh], meta[fresh]
            n, place, hot = meta >> 32, (meta >> 1) & 0x7FFFFFFF, (meta & 1).astype(bool)
            cap = (n - place) * (100 + percent) // percent - n
            start = np.concatenate(([True], (token[1:] != token[:-1]) | (~hot[1:] & (percent * n[1:] > 100 * n[:-1]))))
            group = np.cumsum(start) - 1
            lead = sid[np.flatnonzero(start)][group]
            wide = np.int64(1) << 33  # caps lie in (-wide / 2, wide / 2): one running maximum serves all runs
            most = np.maximum.accumulate(cap + group * wide) - group * wide
            before = np.where(start, -wide, np.concatenate(([0], most[:-1])))
            if len(carry[0]):
                lead[group == 0] = carry[3][0]
                before[group == 0] = np.maximum(before[group == 0], carry[4][0])
            after = np.concatenate((~start[1:] & (n[1:] <= cap[:-1]), [False]))
            keep = (before >= n) | after | hot
            carry = tuple(x[-1:] for x in (token, sid, meta, lead, before))
            keep[-1] = False
            yield out(token[keep], sid[keep], n[keep], lead[keep])
        token, sid, meta, lead, before = carry
        keep = (before >= meta >> 32) | (meta & 1).astype(bool)
        yield out(token[keep], sid[keep], meta[keep] >> 32, lead[keep])

    salt = F.when(F.col("meta") % 2 == 1, F.pmod("sid", F.lit(SALTS))).otherwise(F.lit(0))
    rows = prefix.repartition(F.col("token"), salt).sortWithinPartitions("token", "meta", "sid")
    return rows.mapInArrow(trimmed(scan), "token bigint, sid bigint, n bigint, lead bigint")


class PrefixTree:
    """Sets in the global order, held as a sorted list whose neighbours' common prefixes are the shared tree paths."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        keys = [x.astype(">u4").tobytes() for x in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.place = np.empty(len(sets), np.int64)
        self.place[self.order] = np.arange(len(sets))
        self.shared = np.zeros(len(sets), np.int64)  # with the set before
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[i] = differ[0] if len(differ) else m

    def links(self, x: np.ndarray, flags: np.ndarray, places: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Places of the sets that link with ``x``, of those at ascending ``places``.

        ``flags`` marks the elements of x. Overlap counts along a path are kept
        for the next set that shares it, and a branch is left where what is
        left of both sets cannot bring the overlap to what a link needs.
        """
        last, counts = -1, np.zeros(1, np.int64)
        for j in places.tolist():
            if skip(j):
                continue
            y = self.sets[j]
            depth = int(self.shared[last + 1 : j + 1].min()) if last >= 0 else 0
            have = int(counts[depth])
            need = needed(len(x), len(y), percent)
            rest_x = len(x) - (int(np.searchsorted(x, y[depth - 1], side="right")) if depth else 0)
            if have + min(len(y) - depth, rest_x) < need:
                continue
            grown = np.empty(len(y) + 1, np.int64)
            grown[: depth + 1] = counts[: depth + 1]
            np.cumsum(flags[y[depth:]], out=grown[depth + 1 :])
            grown[depth + 1 :] += have
            last, counts = j, grown
            if grown[-1] >= need:
                yield j


def _tile_links(sids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], rank: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of one tile that join sets not yet joined in it.

    ``side``: 0 and 1 for the two blocks, all 0 where a block meets itself;
    ``sets``: in the global order, as numbers that stand for elements in order.
    """
    n = np.array([len(x) for x in sets])
    size = np.array([prefix_size(k, percent) for k in n])
    token = np.concatenate([x[:k] for x, k in zip(sets, size, strict=True)])
    owner = np.repeat(np.arange(len(sets)), size)
    depth = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
    by = np.lexsort((n[owner], token))
    token, owner, depth = token[by], owner[by], depth[by]
    edges = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
    runs = np.flatnonzero(np.diff(edges) > 1)
    two = bool(side.any())
    pair = np.zeros((len(sets), len(sets)), bool)
    for r in runs.tolist():
        o, d = owner[edges[r] : edges[r + 1]], depth[edges[r] : edges[r + 1]]
        size, left = n[o], n[o] - d
        for s in range(0, len(o), _STRIP):
            part = slice(s, s + _STRIP)
            need = -(-percent * (size[part, None] + size[None, :]) // (100 + percent))
            pair[o[part, None], o[None, :]] |= np.minimum(left[part, None], left[None, :]) >= need
    if two:
        pair &= side[:, None] != side[None, :]
    np.fill_diagonal(pair, False)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    inner = np.flatnonzero(side == 1) if two else np.arange(len(sets))
    asking = np.flatnonzero(side == 0) if two else np.arange(len(sets))
    tree = PrefixTree([sets[i] for i in inner])
    at = inner[tree.order]  # set number by place
    flags = np.zeros(len(rank) + 1, np.int64)
    out = []
    for i in asking.tolist():
        places = np.flatnonzero(pair[i, at] & ((at > i) | two))
        if not len(places):
            continue
        flags[sets[i]] = 1
        for j in tree.links(sets[i], flags, places, percent, lambda p, i=i: root(int(at[p])) == root(i)):
            parent[root(int(at[j]))] = root(i)
            out.append((int(sids[i]), int(sids[at[j]])))
        flags[sets[i]] = 0
    return out


def _tiles(rows: DataFrame, levels: Broadcast, words: int, percent: int) -> DataFrame:
    """Links (a, b) of all tiles; ``rows``: (ta, tb, side, sid, text).

    Texts stand for their sets on the way, as 8 bytes a shingle would outweigh them.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = levels.value
        held: list[tuple] = []

        def solved() -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            if len(held) > 1:
                one = {(r[2], r[3]): r for r in held}  # copies of one set by several tasks
                part = list(one.values())
                sets = [shingles(r[4], words) for r in part]
                every = np.unique(np.concatenate(sets))
                rank = np.empty(len(every), np.int64)
                rank[np.argsort(order[_bucket(every)], kind="stable")] = np.arange(len(every))
                sets = [np.sort(rank[np.searchsorted(every, x)]) for x in sets]
                sids, side = np.array([r[3] for r in part]), np.array([r[2] for r in part])
                if len(part) > 1 and (part[0][0] == part[0][1] or 0 < side.sum() < len(side)):
                    found = _tile_links(sids, side, sets, rank, percent)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                names=["a", "b"],
            )

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("ta", "tb", "side", "sid", "text")), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield solved()
                held.append(row)
        yield solved()

    rows = rows.repartition("ta", "tb").sortWithinPartitions("ta", "tb", "side", "sid")
    return rows.mapInArrow(trimmed(join), "a bigint, b bigint")


def _blocks(runs: DataFrame, rounds: int = 4) -> DataFrame:
    """(sid, block): sets dealt to blocks of bounded size by the least lead that reaches them.

    Leads pass over the distinct (lead, sid) edges for a few rounds, so that
    sets that meet in many runs mostly share a block; where they do not, their
    blocks meet in a tile.
    """
    edges = staged(runs.groupBy("lead", "sid").agg(F.max("n").alias("n")), "run-edges")
    home = edges.groupBy("sid").agg(F.min("lead").alias("home"), F.max("n").alias("n"))
    for _ in range(rounds):
        least = edges.join(home.select("sid", "home"), "sid").groupBy("lead").agg(F.min("home").alias("least"))
        home = edges.join(least, "lead").groupBy("sid").agg(F.min("least").alias("home"), F.max("n").alias("n"))
    home = staged(home, "homes")
    weight = home.groupBy("home").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).alias("parts")
    )
    part = F.pmod(F.xxhash64("sid"), F.col("parts"))
    return home.join(weight, "home").select("sid", F.xxhash64("home", part).alias("block"))


def _places(placed: DataFrame, in_block: DataFrame) -> DataFrame:
    """(sid, ta, tb, side): the tiles a set takes part in.

    ``placed``: (token, sid, block); ``in_block``: (token, block, several), in
    which several sets of the block share the token. Two blocks meet in a tile
    of the sets that share a token with the other one, as no others can link
    across; a block meets itself with the sets that share one within it.
    """
    meeting = in_block.groupBy("token").agg(F.count("*").alias("blocks")).where("blocks > 1").select("token")
    meeting = staged(in_block.join(meeting, "token").select("token", F.col("block").alias("other")), "meeting-blocks")
    own = placed.join(in_block.where("several").select("token", "block"), ["token", "block"], "left_semi")
    own = own.select("sid", F.col("block").alias("ta"), F.col("block").alias("tb"), F.lit(0).alias("side"))
    across = placed.join(small(meeting), "token").where("block <> other").select(
        "sid",
        F.least("block", "other").alias("ta"),
        F.greatest("block", "other").alias("tb"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    return own.union(across).distinct()


def similar_links(docs: DataFrame, sets: DataFrame, *, words: int = 5, percent: int = 75) -> DataFrame:
    """Links (a, b) between different sets; every linked pair is joined by a path of them.

    ``docs``: _text and _tid (a fingerprint of the text); ``sets``: what
    ``_set_rows`` gives, staged.
    """
    spark: SparkSession = docs.sparkSession
    known, mean, scale = _levels(sets.where("chunk IS NOT NULL"))
    levels = spark.sparkContext.broadcast(known)
    hot_level = int(np.ceil(scale * np.log2(16 * mean + 65_536)))
    runs = staged(_runs(_prefix_rows(docs, levels, hot_level, words, percent), percent), "runs")
    blocks = staged(_blocks(runs), "blocks")
    placed = runs.join(blocks, "sid").select("token", "sid", "block")
    in_block = placed.groupBy("token", "block").agg((F.min("sid") < F.max("sid")).alias("several"))
    in_block = staged(in_block, "token-blocks")
    places = staged(_places(placed, in_block), "places")
    at = places.groupBy("sid").agg(F.collect_list(F.struct("ta", "tb", "side")).alias("at"))
    wanted = sets.where("sid IS NOT NULL").select("tid", "sid").distinct().join(at, "sid")
    wanted = staged(wanted.groupBy("tid").agg(F.max(F.struct("sid", "at")).alias("w")).select("tid", "w.*"), "candidates")
    texts = docs.select(F.col("_tid").alias("tid"), "_text").join(small(wanted), "tid").select("sid", "at", "_text")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for sid in batch.column("sid").to_pylist():
                fresh.append(sid not in seen)
                seen.add(sid)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    rows = texts.mapInArrow(once, "sid bigint, at array<struct<ta: bigint, tb: bigint, side: int>>, _text string")
    rows = rows.select("sid", F.col("_text").alias("text"), F.explode("at").alias("p")).select("p.*", "sid", "text")
    return _tiles(rows, levels, words, percent)


def jaccard_components(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75
) -> DataFrame:
    """Groups of near-duplicate texts: key, ``n_shingles`` and ``component_id``.

    Two texts link when 100 times the intersection of their sets of ``words``
    consecutive words is at least ``percent`` times the union; a component is
    what links reach, named by its least key. Equal sets are one set from the
    start. Sets are ordered by a global order, rare shingles first, and meet
    where their prefixes share a shingle; blocks of sets are joined by a tree
    of the sets (see ``PrefixTree``). Which pairs link does not depend on the
    order: the frequency sketch behind it has a fixed size and only decides how
    much work there is. Shingles and sets stand as 64-bit fingerprints.

    Null and empty texts and texts of white space have no shingle and link with
    nothing; their component is their own key. Repeated rows are copies of one
    another; a null key counts for the least key only if all keys of the
    component are null. Other columns are not read.
    """
    rows = docs.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tid")
    )
    sets = staged(_set_rows(rows, words), "sets")
    held = sets.where("sid IS NOT NULL").select("_key", "n", "sid")
    links = staged(similar_links(rows, sets, words=words, percent=percent), "links")
    least = held.where("sid <> 0").groupBy("sid").agg(F.min("_key").alias("least"), F.count("*").alias("rows"))
    tied = components(links).withColumnRenamed("node", "sid")
    grouped = least.join(tied, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    named = grouped.where("component <> sid OR rows > 1").select("component").union(
        tied.select("component")
    ).distinct()
    grouped = grouped.join(named, "component", "left_semi")
    names = grouped.groupBy("component").agg(F.min("least").alias("name"))
    named = staged(grouped.join(names, "component").select("sid", "name"), "names")
    out = held.join(small(named), "sid", "left")
    return out.select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("name", "_key").alias("component_id")
    )
