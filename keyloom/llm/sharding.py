"""Contiguous shards of near-equal bytes, from global prefix sums.

Rows are range-partitioned and sorted by a hash of their text, then by id, so that equal texts follow each other and
only a cut can part them; each partition adds up its bytes, the driver turns those totals (one row a partition) into
offsets, and each partition then runs its prefix sums from its offset. A row goes to the shard in which its middle byte
falls when the total is cut at equal targets, so shards are contiguous in that order and off by less than the largest
text. Slots come from a second, equally small, set of totals: rows by partition and shard.

Cases: null texts have no bytes and go with empty ones; null ids sort first among equal texts; repeated rows each keep
a row, told apart by nothing and so interchangeable; texts of any length are one row's bytes, never cut; a table
without rows gives none; other columns, whatever their names, are not carried. A group of equal texts is spread over
partitions, since the range has every returned column and the row's place in its input as further keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, scan_width

#: Bytes that a row has besides those of its text.
ROW_BYTES = 8


def byte_shards(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null: this law moves any row when a shard is added)."""
    text = F.col(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("mark"),
        F.monotonically_increasing_id().alias("place"),
    )
    keys = ["mark", "doc_id", "text_crc32", "size", "place"]
    rows = durable(rows.repartitionByRange(scan_width(rows), *keys).sortWithinPartitions(*keys).drop("mark", "place"))
    pid = F.spark_partition_id().alias("pid")
    totals = {r.pid: r.n for r in rows.groupBy(pid).agg(F.sum("size").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(totals):
        starts[p], total = total, total + totals[p]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        at = starts.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            size = b.column(1).to_numpy()
            end = at + np.cumsum(size)
            # the middle byte, doubled so as to stay whole
            yield b, np.minimum((2 * end - size) * shards // (2 * total), shards - 1).astype(np.int32)
            at = int(end[-1]) if len(end) else at

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(shards, np.int64)
        for _, shard in cut(batches):
            n += np.bincount(shard, minlength=shards)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"pid": pa.array([TaskContext.get().partitionId()] * len(held), pa.int32()), "shard": pa.array(held, pa.int32()), "n": pa.array(n[held], pa.int64())})

    before: dict[int, dict[int, int]] = {}
    held = [0] * shards
    for r in sorted(rows.mapInArrow(count, "pid int, shard int, n long").collect()):
        before.setdefault(r.pid, {})[r.shard] = held[r.shard]
        held[r.shard] += r.n

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nxt = dict(before.get(TaskContext.get().partitionId(), {}))
        for b, shard in cut(batches):
            slot = np.empty(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                here = shard == s
                n = int(here.sum())
                slot[here] = np.arange(nxt[s], nxt[s] + n)
                nxt[s] += n
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(["bytes"] * len(shard)), pa.array(shard), pa.array(slot), pa.nulls(len(shard), pa.int32())],
                ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(number, f"doc_id {kind}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
