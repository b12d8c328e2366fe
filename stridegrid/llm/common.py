"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast at most, where their width is fixed (ids, fingerprints, spans).
BROADCAST_ROWS = 1_000_000

#: Whether the shuffles of a query are removed when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share.

    The session names it in ``spark.checkpoint.dir``; where it does not, as in
    tests on one machine, the checkpoint folder of the context or a new
    temporary one is taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{(root or tempfile.mkdtemp(prefix='stridegrid-llm-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs no more than its own tasks, and
    later reads see the same rows. The shuffles of the write go with it: left to
    the garbage collector, those of all steps so far would lie on disk together.
    """
    path = shared_path(df.sparkSession, name)
    conf, kept = df.sparkSession.conf, df.sparkSession.conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, kept)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(key: str | Column, folds: int, fold: int) -> Column:
    """True for the rows of one fold by crc32 of the key as text; a null key is in no fold."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``rows`` rows, else as it is.

    ``df`` must be staged, so that counting it costs next to nothing.
    """
    return F.broadcast(df) if df.count() <= rows else df


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int) -> DataFrame:
    """Texts and labels of at most ``limit`` labelled rows, picked by a hash of their ids.

    ``docs`` has doc_id and text, ``labels`` doc_id and the label; ``train`` is
    a condition on doc_id. The picked ids are bounded by ``limit`` and so may
    be broadcast; texts stay distributed.
    """
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("_label"))
        .where(train & F.col("_label").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id")
        .limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


@cache
def one_blas_thread() -> None:
    """Let this Python worker multiply matrices on one thread: a task is one core, and more threads wait for one another.

    Workers fork with numpy loaded, too late for environment variables, so the
    library that numpy brings is told. Without it nothing changes.
    """
    for library in (Path(np.__file__).parents[1] / "numpy.libs").glob("*openblas*"):
        held = ctypes.CDLL(str(library))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(held, name):
                getattr(held, name)(1)


Batches = Iterator[pa.RecordBatch]

#: Rows of a batch that are worked on at a time: arrays per word of a whole batch would outweigh its texts.
ROWS_AT_ONCE = 256


def few_rows(batches: Batches) -> Batches:
    """The rows of Arrow batches, some at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


def trimmed(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` on the batches of a task, after which this Python worker gives freed memory back: it idles until a later task."""

    @wraps(work)
    def run(batches: Batches) -> Batches:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run
