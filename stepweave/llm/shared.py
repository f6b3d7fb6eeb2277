"""Storing tables in the folder that all executors share, and helpers for ids."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the session's checkpoint folder.

    The folder is the one that ``spark.checkpoint.dir`` names. Only where nothing is set, as in local
    tests, a temporary one is made. Files stay for the cluster's retention to remove, since the
    DataFrames returned are read from them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, no lineage to repeat."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """For functions over batches: their task's Python worker gives memory back when they end.

    Workers live on for the next tasks and stages, and what one of them keeps stands beside all that those need."""

    @functools.wraps(work)
    def run(*args: object, **named: object) -> Iterator:
        yield from work(*args, **named)
        give_back()

    return run


def give_back() -> None:
    """Return freed memory to the system, which the allocators would keep for later."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
