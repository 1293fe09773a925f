"""The change log (user_key, seq, op, value) that everything else is a view of; op 1 puts, 0 deletes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import DELETE, PUT, int_key, varint_length
from .ranges import numbered

COLUMNS = ["user_key", "seq", "op", "value"]


def schema(value: T.DataType | None = None) -> T.StructType:
    return T.StructType([T.StructField("user_key", T.StringType(), False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.IntegerType(), False), T.StructField("value", value or T.DoubleType())])


def accepted(batch: DataFrame) -> DataFrame:
    """A batch without null keys: one fails the job that meets it. Deletes lose their value."""
    key = F.coalesce("user_key", F.raise_error(F.lit("a key is null")).cast("string"))
    return batch.withColumn("user_key", key).withColumn("value", F.when(F.col("op") == PUT, F.col("value")))


def puts(df: DataFrame) -> DataFrame:
    return df.withColumn("op", F.lit(PUT))


def deletes(df: DataFrame, kind: str = "double") -> DataFrame:
    return df.select("user_key", F.lit(DELETE).alias("op"), F.lit(None).cast(kind).alias("value"))


def sequenced(batch: DataFrame, order: list[Column], base: int = 0, n: int | None = None) -> DataFrame:
    """A batch's operations numbered on from the last sequence, in their order."""
    return numbered(batch, order, base, "seq", n).select(*COLUMNS)


def appended(*batches: DataFrame) -> DataFrame:
    """Batches (op_ix, op, user_key, value) as one: each one's op_ix goes on after those before it."""
    rows = functools.reduce(DataFrame.unionByName, [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)])
    return numbered(rows, [F.col("_batch"), F.col("op_ix")], -1, "op_ix").select("op_ix", "op", "user_key", "value")


def cleared(batch: DataFrame) -> DataFrame:
    """The batch without its operations: what is left is its header of 12 bytes."""
    return batch.limit(0)


#: Bytes that a group of queued writes grows to, and that a small first write lets it grow by.
GROUP_BYTES, SMALL_BYTES = 1 << 20, 128 << 10


def write_groups(queue: DataFrame) -> DataFrame:
    """queue, writer, group_id: which queued writes (queue, writer, bytes, sync) are committed together. The first of a
    group leads it; others join in order while the group stays below its bound, and one that asks for a sync doesn't
    join a leader that doesn't. Each queue is one store's, bounded by the writers that wait in it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, size, most, synced = None, 0, 0, 0, False
        for b in batches:
            out = []
            for q, _, n, sync in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if q != at:
                    at, group, joins = q, -1, False
                else:
                    joins = size + n <= most and (synced or not sync)
                if joins:
                    size += n
                else:
                    group, size, synced = group + 1, n, sync
                    most = n + SMALL_BYTES if n <= SMALL_BYTES else GROUP_BYTES
                out.append(group)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["queue", "writer", "group_id"])

    rows = queue.select(F.col("queue").cast("bigint").alias("queue"), F.col("writer").cast("bigint").alias("writer"), F.col("bytes").cast("bigint").alias("bytes"), F.col("sync").alias("sync"))
    return rows.repartition("queue").sortWithinPartitions("queue", "writer").mapInArrow(deal, "queue long, writer long, group_id long")


def entry_bytes(log: DataFrame) -> DataFrame:
    """The log with raw_bytes, what an entry takes in memory: length and bytes of the internal key, then of the value."""
    key, value = F.octet_length("user_key") + 8, F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
    return log.withColumn("raw_bytes", (varint_length(key) + key + varint_length(value) + value).cast("bigint"))


def batch_bytes(batch: DataFrame, *by: str) -> DataFrame:
    """Serialised size: a header of 12 bytes, and each operation's tag, key and (if put) value with their lengths."""
    key, value = F.octet_length("user_key"), F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
    size = 1 + varint_length(key) + key + F.when(F.col("op") == PUT, varint_length(value) + value).otherwise(0)
    return batch.groupBy(*by).agg((F.lit(12) + F.coalesce(F.sum(size), F.lit(0))).cast("bigint").alias("bytes"), F.count("*").alias("ops"))


def from_events(events: DataFrame) -> DataFrame:
    """A user's events overwrite each other; errors delete."""
    gone = F.col("event_type") == "error"
    return events.select(int_key(F.col("user_id")).alias("user_key"), (F.col("event_id") + 1).cast("bigint").alias("seq"), F.when(gone, DELETE).otherwise(PUT).alias("op"), F.when(~gone, F.col("value")).alias("value"))


def from_orders(orders: DataFrame, n: int | None = None) -> DataFrame:
    """All orders put, then those with status F deleted."""
    key = int_key(F.col("o_orderkey")).alias("user_key")
    first = orders.select(F.lit(1).alias("wave"), key, F.lit(PUT).alias("op"), F.col("o_totalprice").alias("value"))
    second = orders.where("o_orderstatus = 'F'").select(F.lit(2).alias("wave"), key, F.lit(DELETE).alias("op"), F.lit(None).cast("double").alias("value"))
    return sequenced(first.unionByName(second), [F.col("wave"), F.col("user_key")], n=n)


def from_lineitem(lineitem: DataFrame, n: int | None = None) -> DataFrame:
    """Lines overwrite each other in shipping order; returned ones delete."""
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    gone = F.col("l_returnflag") == "R"
    key = F.concat(int_key(F.col("l_orderkey")), F.lit("."), int_key(F.col("l_linenumber"), 4))
    rows = lineitem.withColumn("user_key", key).withColumn("op", F.when(gone, DELETE).otherwise(PUT)).withColumn("value", F.when(~gone, F.col("l_extendedprice")))
    return sequenced(rows.select("user_key", "op", "value", *order), order, n=n)
