"""Near-duplicate texts by circulant MinHash: two permutations, banding, links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridegrid.llm.common import small, staged
from stridegrid.llm.components import components
from stridegrid.llm.jaccard_join import _blocks, set_id, shingles

#: The permutations are of 2**PLACE_BITS places; a shingle stands at the place of its leading bits.
PLACE_BITS = 20
#: Coordinates of a band, and bands. Sets of similarity s share no band with probability
#: (1 - s**BAND_ROWS)**BANDS: 9e-12 at 0.8, less above.
BAND_ROWS, BANDS = 5, 64
#: Parts into which the rows of a frequent bucket are dealt.
SALTS = 64
_SEED = 20
_AT_ONCE = 512
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _permutations(shifts: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi read from every place for ``shifts`` places around the circle (one row per place, no copy)."""
    rng = np.random.default_rng(_SEED)
    sigma, pi = (rng.permutation(1 << PLACE_BITS).astype(np.int32) for _ in range(2))
    circle = np.concatenate((pi, pi[: shifts - 1]))
    return sigma, np.lib.stride_tricks.sliding_window_view(circle, shifts)


def signature(found: np.ndarray, shifts: int) -> np.ndarray:
    """Coordinate k is the least value of pi, shifted k places around, over the places sigma gives to the set.

    All coordinates of an element stand next to one another in pi, so a
    signature is the minimum over slices.
    """
    sigma, around = _permutations(shifts)
    at = sigma[(found >> np.uint64(64 - PLACE_BITS)).astype(np.int64)]
    least = around[at[:_AT_ONCE]].min(axis=0)
    for k in range(_AT_ONCE, len(at), _AT_ONCE):
        np.minimum(least, around[at[k : k + _AT_ONCE]].min(axis=0), out=least)
    return least


def band_tokens(found: np.ndarray, rows: int = BAND_ROWS, bands: int = BANDS) -> np.ndarray:
    """One 64-bit number per band of the signature of a set; the number of the band is part of it."""
    x = signature(found, rows * bands).reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _ODD
    for k in range(rows):
        h = (h ^ x[:, k]) * _MIX
        h ^= h >> np.uint64(32)
    return h


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """A row per document (_key, tid, n, sid); the first of each set in a task also has its bands."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, sids, bands = [], [], []
            for text in batch.column("_text").to_pylist():
                found = shingles(text, words)
                sid = set_id(found)
                n.append(len(found))
                sids.append(sid)
                bands.append(None if not sid or sid in seen else band_tokens(found).tobytes())
                seen.add(sid)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    batch.column("_tid"),
                    pa.array(n, pa.int64()),
                    pa.array(sids, pa.int64()),
                    pa.array(bands, pa.binary()),
                ],
                names=["_key", "tid", "n", "sid", "bands"],
            )

    kind = docs.schema["_key"].dataType.simpleString()
    return docs.mapInArrow(scan, f"_key {kind}, tid bigint, n bigint, sid bigint, bands binary")


def _band_rows(sets: DataFrame) -> DataFrame:
    """(token, sid, n, salt) for every band of every set.

    From the third set of a bucket in a batch on, rows need no proof that the
    bucket holds another set: they get a salt, so that no frequent bucket is one
    task's; with salt 0 a bucket has two rows per batch at most.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column("bands").to_pylist()
            if not bands:
                continue
            token = np.frombuffer(b"".join(bands), np.int64)
            each = len(token) // len(bands)
            sid, n = (np.repeat(batch.column(x).to_numpy(), each) for x in ("sid", "n"))
            order = np.argsort(token, kind="stable")
            token, sid, n = token[order], sid[order], n[order]
            starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            place = np.arange(len(token)) - np.repeat(starts, np.diff(np.append(starts, len(token))))
            salt = np.where(place < 2, 0, 1 + sid % SALTS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, sid, n, salt)], names=["token", "sid", "n", "salt"])

    rows = sets.where("bands IS NOT NULL").select("sid", "n", "bands")
    return rows.mapInArrow(explode, "token bigint, sid bigint, n bigint, salt int")


def _members(rows: DataFrame) -> DataFrame:
    """(token, sid, n): the buckets that hold two sets at least."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = tuple(np.zeros(0, np.int64) for _ in range(5))  # the last row; whether a set of its bucket was before it

        def out(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "sid", "n"])

        for batch in batches:
            rows = (batch.column(x).to_numpy().astype(np.int64) for x in ("token", "salt", "sid", "n"))
            token, salt, sid, n = (np.concatenate(x) for x in zip(carry[:4], rows, strict=True))
            same = np.concatenate(([False], (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])))
            fresh = ~np.concatenate(([False], sid[1:] == sid[:-1])) | ~same
            token, salt, sid, n = token[fresh], salt[fresh], sid[fresh], n[fresh]
            if not len(token):
                continue
            before = np.concatenate(([False], (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])))
            if len(carry[0]):
                before[0] = bool(carry[4][0])
            keep = before | np.concatenate((before[1:], [False])) | (salt > 0)
            carry = tuple(x[-1:] for x in (token, salt, sid, n, before))
            keep[-1] = False
            yield out(token[keep], sid[keep], n[keep])
        token, salt, sid, n, before = carry
        keep = before.astype(bool) | (salt > 0)
        yield out(token[keep], sid[keep], n[keep])

    rows = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "sid")
    return rows.mapInArrow(scan, "token bigint, sid bigint, n bigint")


def _elements(docs: DataFrame, sets: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(sid, elements) of every set in a bucket, one row each: its shingles as 64-bit numbers in a binary."""
    wanted = sets.select("sid", "tid").join(members.select("sid").distinct(), "sid", "left_semi")
    wanted = staged(wanted.groupBy("sid").agg(F.min("tid").alias("tid")), "candidates")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sids, out = [], []
            for sid, text in zip(batch.column("sid").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if sid not in seen:
                    seen.add(sid)
                    sids.append(sid)
                    out.append(shingles(text, words).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(sids, pa.int64()), pa.array(out, pa.binary())], names=["sid", "elements"]
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sids = batch.column("sid").to_pylist()
            first = [s not in seen and not seen.add(s) for s in sids]
            yield batch.filter(pa.array(first, pa.bool_()))

    texts = docs.select(F.col("_tid").alias("tid"), "_text").join(small(wanted), "tid").select("sid", "_text")
    cuts = texts.mapInArrow(cut, "sid bigint, elements binary")
    return staged(cuts.repartition("sid").mapInArrow(once, "sid bigint, elements binary"), "elements")


def bucket_links(
    sids: np.ndarray, side: np.ndarray, group: np.ndarray, tokens: list[np.ndarray], sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Links between sets that share a bucket and are not yet in one group; a link joins their groups.

    ``side``: 0 and 1 for two blocks that meet, all 0 where a block meets
    itself. ``sets`` are counted in full against one another.
    """
    n = np.array([len(x) for x in sets])
    every, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    sets = [flat[e - k : e] for e, k in zip(ends, n, strict=True)]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in tokens])
    token = np.concatenate(tokens)
    order = np.argsort(token, kind="stable")
    cuts = np.flatnonzero(np.diff(token[order])) + 1
    buckets = [x for x in np.split(owner[order], cuts) if len(x) > 1]
    of: list[list[np.ndarray]] = [[] for _ in sets]
    for b in buckets:
        for i in b.tolist():
            of[i].append(b)
    label = np.unique(group, return_inverse=True)[1]
    two = bool(side.any())
    flags = np.zeros(len(every), np.int32)
    out = []
    for i in range(len(sets)):
        if not of[i] or (two and side[i]):
            continue
        meets = np.zeros(len(sets), bool)
        for b in of[i]:
            meets[b] = True
        meets &= (side == 1) if two else (np.arange(len(sets)) > i)
        meets &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
        flags[sets[i]] = 1
        while True:
            near = np.flatnonzero(meets & (label != label[i]))
            near = near[: max(1, int(np.searchsorted(np.cumsum(n[near]), 200_000)))]
            if not len(near):
                break
            starts = np.cumsum(n[near]) - n[near]
            both = np.add.reduceat(flags[np.concatenate([sets[j] for j in near])], starts)
            for j in near[100 * both >= percent * (n[near] + n[i] - both)].tolist():
                if label[j] != label[i]:
                    out.append((int(sids[i]), int(sids[j])))
                    label[label == label[j]] = label[i]
            meets[near] = False
        flags[sets[i]] = 0
    return out


def _tile_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of all tiles; ``rows``: (ta, tb, side, sid, grp, tokens, elements)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def solved() -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            if len(held) > 1:
                sids, side, group = (np.array([r[k] for r in held]) for k in (1, 0, 2))
                tokens = [np.array(r[3], np.int64) for r in held]
                sets = [np.frombuffer(r[4], np.uint64) for r in held]
                found = bucket_links(sids, side, group, tokens, sets, percent)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"]
            )

        names = ("ta", "tb", "side", "sid", "grp", "tokens", "elements")
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if row[:2] != tile:
                    yield solved()
                    tile = row[:2]
                held.append(row[2:])
        yield solved()

    rows = rows.repartition("ta", "tb").sortWithinPartitions("ta", "tb", "side", "sid")
    return rows.mapInArrow(join, "a bigint, b bigint")


def _blocked(members: DataFrame) -> DataFrame:
    """``members`` with the block of every set: sets that meet in many buckets mostly share one of bounded size."""
    leads = members.groupBy("token").agg(F.min("sid").alias("lead"))
    blocks = staged(_blocks(members.join(leads, "token").select("lead", "sid", "n"), rounds=2), "blocks")
    return staged(members.join(blocks, "sid"), "members-in-blocks")


def _solved(members: DataFrame, elements: DataFrame, percent: int, own: bool, across: bool) -> DataFrame:
    """Links of sets that share a bucket; ``members``: (token, sid, n, grp, block), staged.

    ``own``: blocks meet themselves; ``across``: they meet all others they share
    a bucket with.
    """
    held = members.groupBy("sid", "block").agg(F.min("grp").alias("grp"), F.collect_set("token").alias("tokens"))
    held = staged(held, "sets-in-blocks")
    at = lambda rows, side, ta, tb: rows.select(
        "sid", "grp", "tokens", F.col(ta).alias("ta"), F.col(tb).alias("tb"), F.lit(side).alias("side")
    )
    parts = [at(held, 0, "block", "block")] if own else []
    if across:
        in_block = staged(members.select("token", "block").distinct(), "token-blocks")
        tiles = in_block.withColumnRenamed("block", "ta").join(in_block.withColumnRenamed("block", "tb"), "token")
        tiles = staged(tiles.where("ta < tb").select("ta", "tb").distinct(), "tiles")
        parts += [at(held.join(tiles, held["block"] == tiles[mine]), side, "ta", "tb") for side, mine in ((0, "ta"), (1, "tb"))]
    places = reduce(DataFrame.union, parts)
    return staged(_tile_links(places.join(elements, "sid"), percent), "links")


def _grouped(members: DataFrame, tied: DataFrame) -> DataFrame:
    """``members`` with their groups so far."""
    rows = members.drop("grp").join(tied, "sid", "left")
    return rows.select("token", "sid", "n", "block", F.coalesce("component", "sid").alias("grp"))


def _bucket_groups(members: DataFrame, tied: DataFrame) -> DataFrame:
    """(token, grp, rows, s, lo, hi): a row per group in a bucket, with the set that stands for it and its blocks."""
    each = _grouped(members, tied).groupBy("token", "grp").agg(
        F.count("*").alias("rows"), F.min(F.struct("sid", "n")).alias("s"), F.min("block").alias("lo"), F.max("block").alias("hi")
    )
    return staged(each, "bucket-groups")


def _open(each: DataFrame) -> DataFrame:
    """(token, rows, groups) of buckets that hold several groups in several blocks."""
    told = each.groupBy("token").agg(
        F.sum("rows").alias("rows"), F.count_distinct("grp").alias("groups"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    return staged(told.where("groups > 1 AND lo <> hi").select("token", "rows", "groups"), "open")


def minhash_groups(docs: DataFrame, sets: DataFrame, *, words: int, percent: int) -> DataFrame:
    """(sid, component) of every set that links with another one that shares a band with it.

    Three rounds keep large groups linear: blocks of sets solve themselves;
    then one set of each group found stands for it in every bucket that is
    still open; then blocks meet that share an open bucket where a group has
    more sets than this one.
    """
    members = staged(_members(_band_rows(sets)).withColumn("grp", F.col("sid")), "members")
    elements = _elements(docs, sets, members, words)
    members = _blocked(members)
    links = _solved(members, elements, percent, own=True, across=False)

    def tied(links: DataFrame, so_far: DataFrame | None = None) -> DataFrame:
        if so_far is not None:
            links = links.union(so_far.select(F.col("component").alias("a"), F.col("sid").alias("b")))
        return components(links).withColumnRenamed("node", "sid")

    groups = tied(links)
    each = _bucket_groups(members, groups)
    unsolved = _open(each)
    if not unsolved.isEmpty():
        # groups stand in buckets as one row before buckets are picked, so a large group counts no more than a small one
        each = staged(each.join(unsolved.select("token"), "token", "left_semi"), "open-groups")
        named = staged(each.select("token", "s.*", "grp"), "named")
        groups = tied(_solved(_blocked(named), elements, percent, own=True, across=True), groups)
        now = each.join(groups, each["s.sid"] == groups["sid"], "left")
        unsolved = _open(now.select("token", F.coalesce("component", "grp").alias("grp"), "rows", "lo", "hi"))
        unsolved = unsolved.where("rows > groups")
    if not unsolved.isEmpty():
        rest = members.join(unsolved.select("token"), "token", "left_semi")
        rest = staged(_grouped(rest, groups), "still-open")
        groups = tied(_solved(rest, elements, percent, own=False, across=True), groups)
    return groups


def minhash_components(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 2, percent: int = 80
) -> DataFrame:
    """Groups of near-duplicate texts: key, ``n_shingles``, ``component_id`` and ``kept``.

    Texts link when 100 times the intersection of their sets of ``words``
    consecutive words is at least ``percent`` times the union; a component is
    what links reach, named by its least key, and the row of that key is kept.
    Candidates share a band of their circulant MinHash signatures (see
    ``BAND_ROWS`` for the chance to share none); every link is counted on the
    full sets. Equal sets are one set from the start. Shingles and sets stand as
    64-bit fingerprints.

    Null and empty texts and texts of white space have no shingle and link with
    nothing; their component is their own key. Repeated rows are copies of one
    another: all rows that have the least key are kept. A null key counts for
    the least key only if all keys of the component are null, and such rows are
    kept. Other columns are not read.
    """
    rows = docs.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tid")
    )
    sets = staged(_signed(rows, words), "signed-sets")
    tied = minhash_groups(rows, sets, words=words, percent=percent)
    least = sets.where("sid <> 0").groupBy("sid").agg(F.min("_key").alias("least"), F.count("*").alias("rows"))
    least = staged(least.join(tied, "sid", "left").where("component IS NOT NULL OR rows > 1"), "least-keys")
    names = least.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("name"))
    named = least.join(small(staged(names, "names")), "component", "left")
    named = staged(named.select("sid", F.coalesce("name", "least").alias("name")), "named-sets")
    out = sets.select("_key", "n", "sid").join(small(named), "sid", "left")
    out = out.withColumn("component", F.coalesce("name", "_key"))
    return out.select(
        F.col("_key").alias(key),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("_key").eqNullSafe(F.col("component")).alias("kept"),
    )
