"""Ordered computation over timelines that do not fit one task.

A timeline is a set of rows with a key (one recording) and a dense 0-based
position. One recording may hold a large share of all rows, so no operator
here sorts or scans a whole recording in one task: positions are cut into
fixed-size blocks and every shuffle is on ``(key, block)``.

* ``neighbourhood``   bounded frames: rows near a block border are copied into
  the neighbouring block, the window runs inside the block, copies are dropped.
* ``running``         unbounded frames: one summary row per block, a window over
  the summaries, then the window inside the block plus the carried value.
* ``affine_recurrence`` first-order linear recurrences with the same two levels.
* ``stateful_rows``   any recurrence: blocks start from a warm-up, the state
  reached is checked against the previous block and repaired where it differs.
* ``dense_position``  row numbers without one task per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridegrid.plans.session import cut

DEFAULT_BLOCK_ROWS = 65_536


@dataclass(frozen=True)
class Line:
    """Key columns, dense position column and rows per block."""

    keys: tuple[str, ...] = ("run_id",)
    pos: str = "frame_index"
    block: int = DEFAULT_BLOCK_ROWS
    tie: tuple[str, ...] = ()

    def by(self, *keys: str) -> "Line":
        return replace(self, keys=tuple(keys))

    def block_of(self, shift: int = 0) -> Column:
        return F.floor((F.col(self.pos) + F.lit(shift)) / F.lit(self.block)).cast("long")


RUNS = Line()


def _with_halo(df: DataFrame, line: Line, before: int, after: int) -> DataFrame:
    """Copy each row to every block whose rows may look at it."""
    first = F.greatest(F.lit(0).cast("long"), line.block_of(-after))
    return df.withColumn("_home", line.block_of()).withColumn(
        "_blk", F.explode(F.sequence(first, line.block_of(before)))
    )


def neighbourhood(
    df: DataFrame,
    line: Line,
    reach: int,
    exprs: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Add window expressions that look at most ``reach`` rows either way."""
    spread = _with_halo(df, line, reach, reach)
    w = Window.partitionBy(*line.keys, "_blk").orderBy(line.pos)
    cols = exprs(w)
    kept = [c for c in df.columns if c not in cols]
    return (
        spread.select(*kept, "_blk", "_home", *[c.alias(n) for n, c in cols.items()])
        .where(F.col("_blk") == F.col("_home"))
        .drop("_blk", "_home")
    )


_FORWARD = {"sum", "sum_before", "last", "prev", "max", "max_before"}
_BACKWARD = {"next", "after"}


def running(df: DataFrame, line: Line, **scans: tuple[str, Column]) -> DataFrame:
    """Add unbounded scans, given as ``name=(kind, column)``.

    ``sum`` / ``sum_before`` running sum with / without the row itself;
    ``last`` / ``prev`` latest non-null value at or before / before the row;
    ``next`` / ``after`` earliest non-null value at or after / after the row;
    ``max`` / ``max_before`` running maximum.
    """
    keys, pos = list(line.keys), line.pos
    cols = {n: f"_v_{n}" for n in scans}
    base = df.withColumn("_blk", line.block_of()).withColumns(
        {cols[n]: c for n, (_, c) in scans.items()}
    )
    summaries, carries = [], []
    past = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    for n, (kind, _) in scans.items():
        v = F.col(cols[n])
        tagged = F.when(v.isNotNull(), F.struct(pos, *line.tie, v.alias("v")))
        if kind.startswith("sum"):
            summaries.append(F.sum(v).alias(f"_b_{n}"))
            carries.append(F.sum(f"_b_{n}").over(past).alias(f"_c_{n}"))
        elif kind.startswith("max"):
            summaries.append(F.max(v).alias(f"_b_{n}"))
            carries.append(F.max(f"_b_{n}").over(past).alias(f"_c_{n}"))
        elif kind in ("last", "prev"):
            summaries.append(F.max(tagged)["v"].alias(f"_b_{n}"))
            carries.append(F.last(f"_b_{n}", ignorenulls=True).over(past).alias(f"_c_{n}"))
        elif kind in _BACKWARD:
            summaries.append(F.min(tagged)["v"].alias(f"_b_{n}"))
            carries.append(F.last(f"_b_{n}", ignorenulls=True).over(future).alias(f"_c_{n}"))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")
    carry = base.groupBy(*keys, "_blk").agg(*summaries).select(*keys, "_blk", *carries)
    inner = Window.partitionBy(*keys, "_blk").orderBy(pos, *line.tie)
    # a frame that ends with the block is summed anew for every row; backwards it grows row by row
    back = Window.partitionBy(*keys, "_blk").orderBy(F.desc("_nth"))
    if any(kind in _BACKWARD for kind, _ in scans.values()):
        base = base.withColumn("_nth", F.row_number().over(inner))
    out = []
    for n, (kind, _) in scans.items():
        v, c = F.col(cols[n]), F.col(f"_c_{n}")
        upto = inner.rowsBetween(Window.unboundedPreceding, 0)
        before = inner.rowsBetween(Window.unboundedPreceding, -1)
        onward = back.rowsBetween(Window.unboundedPreceding, 0)
        beyond = back.rowsBetween(Window.unboundedPreceding, -1)
        if kind.startswith("sum"):
            local = F.sum(v).over(upto if kind == "sum" else before)
            value = F.coalesce(local + c, local, c)
        elif kind.startswith("max"):
            value = F.greatest(F.max(v).over(upto if kind == "max" else before), c)
        elif kind in ("last", "prev"):
            value = F.coalesce(
                F.last(v, ignorenulls=True).over(upto if kind == "last" else before), c
            )
        else:
            value = F.coalesce(
                F.last(v, ignorenulls=True).over(onward if kind == "next" else beyond), c
            )
        out.append(value.alias(n))
    kept = [c for c in df.columns if c not in scans]
    return base.join(carry, [*keys, "_blk"], "left").select(*kept, *out)


def dense_position(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "frame_index"
) -> DataFrame:
    """0-based position of each row within its key.

    ``bucket`` must not decrease along ``order``; rows are numbered inside
    ``(key, bucket)`` and shifted by the count of the buckets before.
    """
    base = df.withColumn("_bkt", bucket)
    shift = base.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    shift = shift.select(
        *keys,
        "_bkt",
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy(*keys)
                .orderBy("_bkt")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_shift"),
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_bkt").orderBy(*order))
    return (
        base.join(shift, [*keys, "_bkt"])
        .withColumn(out, (local - 1 + F.col("_shift")).cast("long"))
        .drop("_bkt", "_shift")
    )


def _in_blocks(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Rows of every key streamed in order of ``pos``; ``_first`` marks where a key begins."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) == 1
    return for_python(df, *keys).withColumn("_first", first).sortWithinPartitions(*keys, pos)


def _chain(triples: list[tuple[str, str, str]], schema: T.StructType):
    """Carry-in of every block from the block maps ``y -> a*y + b``, for all keys of a task in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict.fromkeys((c for _, _, c in triples), 0.0)
        for batch in batches:
            fresh = batch.column("_first").to_pylist()
            out = {}
            for a, b, c in triples:
                y, out[c] = held[c], []
                maps = (batch.column(x).to_numpy(zero_copy_only=False).tolist() for x in (a, b))
                for ai, bi, new in zip(*maps, fresh):
                    y = 0.0 if new else y
                    out[c].append(y)
                    y = ai * y + bi
                held[c] = y
            columns = [pa.array(out[f.name], pa.float64()) if f.name in out else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def affine_recurrence(
    df: DataFrame, line: Line, **outputs: tuple[Column, Column]
) -> DataFrame:
    """Add ``y[k] = a[k] * y[k-1] + b[k]`` with ``y[-1] = 0``, as ``name=(a, b)``.

    Each block is solved from zero together with its running product of ``a``;
    the carry of earlier blocks enters as ``y = local + product * carry``.
    """
    keys, pos = list(line.keys), line.pos
    base = df.withColumn("_blk", line.block_of())
    names = list(outputs)
    base = base.withColumns(
        {f"_{p}_{n}": c.cast("double") for n, ab in outputs.items() for p, c in zip("ab", ab)}
    )
    kept = list(df.columns)
    in_fields = [base.schema[c] for c in kept]
    schema = T.StructType(
        [
            *in_fields,
            T.StructField("_blk", T.LongType()),
            *[T.StructField(f"_{p}_{n}", T.DoubleType()) for n in names for p in "yp"],
        ]
    )

    carried = [f"_{p}_{n}" for n in names for p in "ab"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, ps = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for batch in batches:
            fresh = batch.column("_first").to_pylist()
            solved = {}
            for n in names:
                # missing factors spoil what follows them, as numbers do
                a, b = (batch.column(f"_{p}_{n}").to_numpy(zero_copy_only=False).tolist() for p in "ab")
                solved[n] = ([], [])
                y, p, (at_y, at_p) = ys[n], ps[n], solved[n]
                for ai, bi, new in zip(a, b, fresh):
                    if new:
                        y, p = 0.0, 1.0
                    y = ai * y + bi
                    p *= ai
                    at_y.append(y)
                    at_p.append(p)
                ys[n], ps[n] = y, p
            columns = [batch.column(c) for c in (*kept, "_blk")] + [pa.array(x, pa.float64()) for n in names for x in solved[n]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ordered = _in_blocks(base, [*keys, "_blk"], pos).select(*kept, "_blk", "_first", *carried)
    local = cut(ordered.mapInArrow(solve, schema))
    ends = local.groupBy(*keys, "_blk").agg(
        *[F.max_by(f"_p_{n}", pos).alias(f"_a_{n}") for n in names],
        *[F.max_by(f"_y_{n}", pos).alias(f"_b_{n}") for n in names],
    )
    triples = [(f"_a_{n}", f"_b_{n}", f"_c_{n}") for n in names]
    carry_schema = T.StructType(
        [
            *[base.schema[k] for k in keys],
            T.StructField("_blk", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for _, _, c in triples],
        ]
    )
    carry = _in_blocks(ends, keys, "_blk").mapInArrow(_chain(triples, carry_schema), carry_schema)
    return local.join(carry, [*keys, "_blk"]).select(
        *kept,
        *[(F.col(f"_y_{n}") + F.col(f"_p_{n}") * F.col(f"_c_{n}")).alias(n) for n in names],
    )


Step = Callable[[np.ndarray | None, pd.DataFrame], tuple[pd.DataFrame, np.ndarray]]


def in_order(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Co-locate keys and sort each partition so that groups stream in order."""
    return for_python(df, *keys).sortWithinPartitions(*keys, *order)


def for_python(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition for Python work.

    The count is given so that adaptive coalescing, which goes by bytes, does
    not put row-by-row Python work of many groups into one task.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *keys)


#: Rows that a task of a shuffle given by ``dealt`` holds on average.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a table so that tasks do not grow with it; small tables are left to the session's count."""
    rows = df.count()
    if rows <= TASK_ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(-(-rows // TASK_ROWS), *keys)


def spread(df: DataFrame, *keys: Column) -> DataFrame:
    """Deal rows out before long work on each, where few tasks read them: a file of one row group is one task's."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = df.select(F.spark_partition_id().alias("t")).distinct().count()
    return df if 2 * tasks > count else df.repartition(count, *keys)


def key_runs(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the rows of each key begin in rows sorted by key, and the end of all; nulls are one key."""
    new = np.zeros(max(0, len(pdf) - 1), bool)
    for k in keys:
        v = pdf[k]
        gone = v.isna().to_numpy()
        v = v.to_numpy()
        new |= (gone[1:] != gone[:-1]) | ((v[1:] != v[:-1]) & ~gone[1:])
    return np.concatenate(([0], np.flatnonzero(new) + 1, [len(pdf)]))


#: Rows that ``stream_many`` gathers before it advances their keys together.
ROWS_TOGETHER = 65_536


def stream_many(
    df: DataFrame, keys: list[str], order: list[str], schema: T.StructType, start: Callable[[], object],
    advance: Callable[[list, np.ndarray, pd.DataFrame], tuple[list, pd.DataFrame]],
    whole: list[str] | None = None, gather: int = ROWS_TOGETHER,
) -> DataFrame:
    """Rows of every key in order through ``advance(states, edges, rows) -> (states, out)``, many keys at a time.

    ``rows`` are sorted by key and ``edges`` says where the rows of each begin,
    and the end of all; there is a state per key. A task gathers Arrow batches
    until they have ``gather`` rows, so it holds their states and rows; the
    last key goes on with its state. ``out`` has a row per given row and is
    returned behind ``keys``. ``whole``: columns behind the keys whose equal
    rows must not be cut by a batch.
    """
    unit = [*keys, *(whole or [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = None, None

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal state, last
            edges = key_runs(pdf, keys)
            goes_on = last is not None and len(key_runs(pd.concat([last, pdf.iloc[:1][keys]]), keys)) == 2
            states = [state if goes_on else start(), *(start() for _ in edges[2:])]
            states, out = advance(states, edges, pdf)
            state, last = states[-1], pdf.iloc[-1:][keys]
            return pd.concat([pdf[keys].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

        rest: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            rest.append(pdf)
            if sum(map(len, rest)) < gather:
                continue
            pdf = rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)
            end = len(pdf) if whole is None else int(key_runs(pdf, unit)[-2])
            rest = [pdf.iloc[end:]] if end < len(pdf) else []
            if end:
                yield solve(pdf.iloc[:end])
        if rest:
            yield solve(rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True))

    return in_order(df, keys, *order).mapInPandas(run, schema)


def stream_keys(
    df: DataFrame, keys: list[str], order: list[str], schema: T.StructType,
    start: Callable[[], object], advance: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]],
    whole: list[str] | None = None,
) -> DataFrame:
    """Rows of every key in order through ``advance(state, rows) -> (state, out)``, one key after another.

    A task streams its keys in Arrow batches of many keys, so it holds one
    batch and the states of its keys, and a key costs no call of its own.
    """

    def each(states: list, edges: np.ndarray, pdf: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        parts = []
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            state, out = advance(states[i], pdf.iloc[a:b])
            states[i] = state if b == len(pdf) else None
            parts.append(out)
        return states, parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)

    return stream_many(df, keys, order, schema, start, each, whole, gather=1)


def stateful_rows(
    df: DataFrame,
    line: Line,
    step: Step,
    out_fields: list[T.StructField],
    warmup: int,
    tolerance: float = 1e-12,
) -> DataFrame:
    """Run ``step(state, rows) -> (rows_out, state)`` along every timeline.

    ``state`` is a flat float vector. ``step`` must forget its start: blocks
    begin ``warmup`` rows early with no state. A block whose start state differs
    from the end state of the block before is run again from that state, until
    all agree, so the result is that of one pass over the whole timeline.
    """
    keys, pos = list(line.keys), line.pos
    schema = T.StructType([*[df.schema[k] for k in keys], df.schema[pos], *out_fields])
    wanted = [f.name for f in schema]
    state_type = T.ArrayType(T.DoubleType())
    # the start stands on the first row of a block, the end on the last row of every piece of it
    blk_schema = T.StructType(
        [
            *schema.fields,
            T.StructField("_blk", T.LongType()),
            T.StructField("_start", state_type),
            T.StructField("_end", state_type),
            T.StructField("_seen", T.LongType()),
        ]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, seen, last = None, 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            edges, parts = key_runs(pdf, [*keys, "_blk"]).tolist(), []
            for a, b in zip(edges[:-1], edges[1:]):
                rows = pdf.iloc[a:b]
                ident = rows.iloc[:1][[*keys, "_blk"]]
                if a or last is None or len(key_runs(pd.concat([last, ident]), [*keys, "_blk"])) > 2:
                    given = rows["_given"].iloc[0] if "_given" in rows else None
                    state, seen = None if given is None else np.asarray(given, dtype=float), 0
                early = int((rows["_home"].to_numpy() < rows["_blk"].to_numpy()).sum())
                if early:
                    _, state = step(state, rows.iloc[:early])
                own = rows.iloc[early:]
                if not len(own):
                    continue
                start = None if state is None or seen else [float(v) for v in state]
                out, state = step(state, own)
                out = out[wanted].copy()
                seen, rest = seen + len(out), [None] * (len(out) - 1)
                out["_blk"] = own["_blk"].to_numpy()
                out["_start"] = [start, *rest]
                out["_end"] = [*rest, [float(v) for v in state]]
                out["_seen"] = pd.array([*rest, seen], dtype="Int64")
                parts.append(out)
            last = pdf.iloc[-1:][[*keys, "_blk"]]
            if parts:
                yield pd.concat(parts, ignore_index=True)

    source = cut(df)
    spread = _with_halo(source, line, warmup, 0)
    spread = for_python(spread, *keys, "_blk")
    ordered = lambda rows: rows.sortWithinPartitions(*keys, "_blk", pos)
    solved = cut(ordered(spread).mapInPandas(solve, blk_schema))
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    while True:
        states = solved.groupBy(*keys, "_blk").agg(
            F.max("_start").alias("_start"), F.max_by("_end", "_seen").alias("_end")
        )
        states = states.withColumn("_want", F.lag("_end").over(by_block))
        off = F.exists(
            F.zip_with(
                "_start",
                "_want",
                lambda a, b: ~(F.abs(a - b) <= tolerance * (1 + F.abs(b)))
                & ~(F.isnan(a) & F.isnan(b)),
            ),
            lambda bad: F.coalesce(bad, F.lit(True)),
        )
        wrong = cut(
            states.where(F.col("_want").isNotNull() & F.coalesce(off, F.lit(True))).select(
                *keys, "_blk", F.col("_want").alias("_given")
            )
        )
        if wrong.isEmpty():
            return solved.select(*wanted)
        again = (
            source.withColumn("_home", line.block_of())
            .withColumn("_blk", line.block_of())
            .join(wrong, [*keys, "_blk"])
        )
        again = ordered(for_python(again, *keys, "_blk")).mapInPandas(solve, blk_schema)
        solved = cut(
            solved.join(wrong.drop("_given"), [*keys, "_blk"], "left_anti").unionByName(again)
        )
