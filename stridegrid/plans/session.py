"""Session helpers: local test session and lineage cutting."""

from __future__ import annotations

import ctypes
import os
import tempfile
from functools import cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stridegrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STRIDEGRID_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def typed_state(spark: SparkSession) -> None:
    """Let the streams that start from now on keep typed state.

    Spark's default store has one column family and typed state needs several,
    so a session left at that default is given the RocksDB store. A store chosen
    otherwise stays, and a stream that restarts keeps the one of its checkpoint.
    """
    name, folder = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state"
    if spark.conf.get(name).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(name, f"{folder}.RocksDBStateStoreProvider")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where none is named (tests on one machine) is a fresh one made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stridegrid-ckpt-"))
    return df.checkpoint(eager=True)


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
