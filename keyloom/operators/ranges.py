"""Total order at scale: rows dealt to ranges of an order, so that global windows become windows in a range plus a
carry from a table with one row a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable

#: Rows from which another range is made, ranges at most, and sampled rows for each.
ROWS, MOST, SAMPLED = 500_000, 1 << 14, 30
#: Bits of a row's place in its partition in Spark's increasing ids.
PLACE = (1 << 33) - 1


def ranged(df: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """df with _range, which grows along the order; where the bounds lie changes the spread only.

    Bounds are found by a search over a literal array, of as many steps as the number of ranges has bits; each step is
    a projection of its own, so that none is computed twice.
    """
    rows = None
    if n is None:
        rows = df.count()
        n = min(MOST, rows // ROWS + 1)
    if n == 1:
        return df.withColumn("_range", F.lit(0))
    rows = df.count() if rows is None else rows
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    sample = sorted(tuple(r[0]) for r in df.select(key).sample(min(1.0, SAMPLED * n / max(rows, 1)), seed=7).collect())
    bounds = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    kinds = [f.dataType for f in df.select(key.alias("k")).schema["k"].dataType]
    literal = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, kinds, strict=True))]) for b in bounds])
    out = df.withColumn("_key", key).withColumn("_range", F.lit(0))
    for bit in reversed(range(len(bounds).bit_length())):
        to = F.col("_range") + (1 << bit)
        out = out.withColumn("_range", F.when((to <= len(bounds)) & (F.get(literal, to - 1) <= F.col("_key")), to).otherwise(F.col("_range")))
    return out.drop("_key")


def carried(df: DataFrame, value: Column, later: bool) -> DataFrame:
    """_range and carry: of the ranges after (or before) it, the value nearest to it; one row a range."""
    edge = df.groupBy("_range").agg((F.min(value) if later else F.max(value)).alias("v"))
    w = Window.orderBy("_range")
    w = w.rowsBetween(1, Window.unboundedFollowing) if later else w.rowsBetween(Window.unboundedPreceding, -1)
    return edge.select("_range", (F.min("v") if later else F.max("v")).over(w).alias("carry"))


def summed_before(df: DataFrame, value: Column) -> DataFrame:
    """_range and before: the sum of the value over all ranges before it; one row a range."""
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy("_range").agg(F.sum(value).alias("v")).select("_range", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("before"))


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str, n: int | None = None) -> DataFrame:
    """df with the sum of the value from the order's first row to this one."""
    rows = ranged(df.withColumn("_value", value), order, n)
    here = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("_here", here).join(F.broadcast(summed_before(rows, F.col("_value"))), "_range")
    return out.withColumn(name, (F.col("before") + F.col("_here")).cast("bigint")).drop("_range", "_value", "_here", "before")


def following(df: DataFrame, order: list[Column], value: Column, name: str, n: int | None = None) -> DataFrame:
    """df with the value of the row before this one in the order, wherever the ranges are cut; null for the first."""
    rows = ranged(df.withColumn("_value", value), order, n)
    place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("_value").alias("v"))
    last = carried(rows, place, False)
    lag = F.lag(F.struct(F.col("_value").alias("v"))).over(Window.partitionBy("_range").orderBy(*order))
    out = rows.withColumn("_lag", lag).join(F.broadcast(last), "_range")
    return out.withColumn(name, F.coalesce(F.col("_lag.v"), F.when(F.col("_lag").isNull(), F.col("carry.v")))).drop("_range", "_value", "_lag", "carry")


def numbered(df: DataFrame, order: list[Column], base: int = 0, name: str = "seq", n: int | None = None) -> DataFrame:
    """df with base + 1, base + 2, ... along a total order, without gaps.

    Rows are range-partitioned and sorted once and stored; a row's place in its partition and the sizes of the
    partitions before it (one row a partition) give its number, without a window.
    """
    parts = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    rows = rows.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE)) + 1)
    sizes, starts, at = dict(map(tuple, rows.groupBy("_range").count().collect())), [], base
    for i in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(i, 0)
    before = F.get(F.array(*[F.lit(x).cast("bigint") for x in starts or [0]]), F.col("_range"))
    return rows.withColumn(name, (before + F.col("_place")).cast("bigint")).drop("_range", "_place")
