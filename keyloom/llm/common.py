"""Shared plumbing: reading, samples, Arrow batch helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable, shared_folder

__all__ = ["durable", "hash_bound", "keep_rows", "kept_by_worker", "let_go", "scan_width", "shared_folder", "slices", "table", "texts"]

#: Bytes of an Arrow batch, unless the session has a lower bound: texts may be long, and an executor's memory holds a
#: batch several times over (in both processes, as strings, and in buffers that the JVM keeps once they have grown).
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns only. Arrow batches are bounded by bytes, not rows: the session's bound is lowered to ours if
    it is above it (Spark reads it when a plan runs, so it can't be set for one operator alone)."""
    spark = df.sparkSession
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BYTES)) <= BATCH_BYTES:
        spark.conf.set(BYTES, str(BATCH_BYTES))
    return df.select(*cols)


def hash_bound(n: int, least: int, wanted: int) -> int:
    """The 64-bit hash up to which about `wanted` of n rows lie. It is never below the least hash, so that whatever
    has rows has a sample, and whole numbers keep it exact at any n."""
    return max(least, min((1 << 63) - 1, (wanted << 64) // max(n, 1) - (1 << 63)))


def scan_width(df: DataFrame) -> int:
    """Partitions that a scan of df takes: the natural spread of its rows."""
    return max(1, df.rdd.getNumPartitions())


def keep_rows(df: DataFrame, text_col: str, mask: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Rows of df, all columns unchanged, whose text passes; mask() is built once in each task.

    Narrow: no shuffle, and the columns other than the text are passed on as Arrow buffers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = mask()
        for b in batches:
            yield b.filter(pa.array(test(b.column(text_col).to_pylist()), pa.bool_()))

    return texts(df, *[F.col(f"`{c}`") for c in df.columns]).mapInArrow(run, df.schema)


_held: dict = {}


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: the last key's value only, since workers outlive the operators
    that they serve, and the memos of several would add up in an executor's memory."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Frees what a Python worker keeps, where a task that has no use for it follows, and hands the memory back to the
    system: allocators hold on to much of it, which an executor would have beside what the next stages take."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)  # glibc has it


def slices(values: list, weight: Callable[[object], int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of values whose weights add up to about `most`; one value is never cut."""
    lo, total = 0, 0
    for i, v in enumerate(values):
        w = weight(v)
        if i > lo and total + w > most:
            yield lo, i
            lo, total = i, 0
        total += w
    if lo < len(values):
        yield lo, len(values)
