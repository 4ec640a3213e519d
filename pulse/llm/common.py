"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions import storage
from pulse.functions.storage import at_end, lasting, release, remove, scope, shared_dir, trim

__all__ = ["at_end", "claim", "in_small_batches", "lasting", "lean", "release", "remove", "scope", "shared_dir", "shuffle_partitions", "slices", "stored", "table", "text_or_empty"]


ROWS_PER_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """As in storage, after the driver's JVM has given back what plans before have left beside its heap."""
    trim(df.sparkSession)
    return storage.stored(df)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches of ROWS_PER_BATCH rows at most: vectors of whole texts are grown by doubling, in memory beside the heap."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS_PER_BATCH:
        conf.set(key, str(ROWS_PER_BATCH))
    return df


def slices(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about limit at most."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


M_MMAP_THRESHOLD, LARGE = -3, 4 << 20  # as in malloc.h; bytes
KEPT = 200 << 20  # what a process may keep between tasks without looking for more to give back

_holders: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Drops what other operators keep in this Python process, which Spark reuses, before owner fills its own caches."""
    others = [f for name, f in _holders.items() if name != owner]
    if owner not in _holders:
        for f in others:
            f()
        _holders.clear()
        gc.collect()
        _give_back()
    _holders[owner] = clear


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose Python process, which Spark reuses and keeps, gives back at the end of each task what the task freed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if resident() > KEPT:
                _give_back()

    return task


def resident() -> int:
    """Bytes that this process has in memory; 0 where the system doesn't tell."""
    with contextlib.suppress(OSError), open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    return 0


def _give_back() -> None:
    """Returns free memory to the system, and has large arrays returned as soon as they are dropped."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(M_MMAP_THRESHOLD, LARGE)
        libc.malloc_trim(0)


def text_or_empty(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
