"""Ordered reads of a live view (user_key, seq, value): ranges, prefixes, pages, seeks and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import has_prefix
from .ranges import carried, numbered, ranged


def range_scan(view: DataFrame, start: str | None = None, limit: str | None = None, reverse: bool = False) -> DataFrame:
    """Keys in [start, limit), in key order; None leaves an end open."""
    if start is not None:
        view = view.where(F.col("user_key") >= start)
    if limit is not None:
        view = view.where(F.col("user_key") < limit)
    return view.orderBy(F.desc("user_key") if reverse else F.asc("user_key"))


def prefix_scan(view: DataFrame, prefix: str) -> DataFrame:
    return view.where(has_prefix(F.col("user_key"), prefix)).orderBy("user_key")


def page_after(view: DataFrame, last: str, rows: int) -> DataFrame:
    """The next page after the last key of the one before."""
    return view.where(F.col("user_key") > last).orderBy("user_key").limit(rows)


def first(view: DataFrame, n: int = 1) -> DataFrame:
    return view.orderBy("user_key").limit(n)


def last(view: DataFrame, n: int = 1) -> DataFrame:
    return view.orderBy(F.desc("user_key")).limit(n)


def at_position(view: DataFrame, *positions: int) -> DataFrame:
    """Rows at ordinals of the key order, counted from 1."""
    return numbered(view, [F.col("user_key")], name="position").where(F.col("position").isin(*positions))


def nearest(held: DataFrame, asked: DataFrame, order: list[str], hit: Column, forward: bool, n: int | None = None) -> DataFrame:
    """asked's columns (the order's) and hit: of the held rows, the first that is not before each asked place, or the
    last that is not after it (where equal places count, asked must sort so). Nothing is compared pairwise: both sides
    go through one order, and a hit is carried along it, over range edges too."""
    kinds = held.select(hit.alias("hit")).schema["hit"].dataType
    rows = held.select(*order, F.lit(1).alias("kind"), hit.alias("hit")).unionByName(asked.select(*order, F.lit(0 if forward else 2).alias("kind"), F.lit(None).cast(kinds).alias("hit")))
    place = [*order, "kind"]
    rows = ranged(rows, [F.col(c) for c in place], n)
    # a forward seek reads the order from its end: frames that grow row by row stay linear
    w = Window.partitionBy("_range").orderBy(*[F.desc(c) if forward else F.asc(c) for c in place]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("near", F.last("hit", ignorenulls=True).over(w)).where("kind != 1")
    # of a range's hits the one nearest to its edge: the order's columns say which
    edge = F.when(F.col("hit").isNotNull(), F.struct(*order, F.col("hit").alias("hit")))
    out = found.join(F.broadcast(carried(rows, edge, later=forward)), "_range")
    return out.select(*order, F.coalesce("near", F.col("carry.hit")).alias("hit"))


def seek_many(view: DataFrame, targets: DataFrame, forward: bool = True, n: int | None = None) -> DataFrame:
    """target, found_key, value: for each distinct target the first live key that is not below it (forward), or the
    last one that is below it; nulls where there is none."""
    asked = targets.select(F.col("target").alias("user_key"), F.lit(0).alias("at")).distinct()
    # at equal keys the target comes first, so a forward seek meets the key and a backward one doesn't
    held = view.withColumn("at", F.lit(1))
    out = nearest(held, asked, ["user_key", "at"], F.struct("user_key", "value"), forward, n)
    return out.select(F.col("user_key").alias("target"), F.col("hit.user_key").alias("found_key"), F.col("hit.value").alias("value"))


def exact_hits(view: DataFrame, targets: DataFrame, n: int | None = None) -> DataFrame:
    """asked and found: of the targets sought, how many are live keys themselves."""
    out = seek_many(view, targets, True, n)
    return out.agg(F.count("*").alias("asked"), F.count(F.when(F.col("target") == F.col("found_key"), 1)).alias("found"))


def merged(schema: T.StructType, *children: DataFrame, spark: SparkSession, reverse: bool = False) -> DataFrame:
    """Any number of change logs as one, in internal order: none gives no rows, one passes as it is but for the order.
    Rows that are equal in that order come by the rank of their child: rising, or falling when read in reverse."""
    out = spark.createDataFrame([], schema).withColumn("_child", F.lit(-1))
    for i, c in enumerate(children):
        out = out.unionByName(c.select(*schema.names).withColumn("_child", F.lit(i)))
    order = [F.asc("user_key"), F.desc("seq"), F.desc("op"), F.asc("_child")]
    back = [F.desc("user_key"), F.asc("seq"), F.asc("op"), F.desc("_child")]
    return out.orderBy(*(back if reverse else order)).drop("_child")


def neighbours(view: DataFrame, n: int | None = None) -> DataFrame:
    """user_key, previous_key, next_key."""
    rows = ranged(view.select("user_key"), [F.col("user_key")], n)
    w = Window.partitionBy("_range").orderBy("user_key")
    out = rows.withColumn("p", F.lag("user_key").over(w)).withColumn("x", F.lead("user_key").over(w))
    before, after = carried(rows, F.col("user_key"), False).withColumnRenamed("carry", "b"), carried(rows, F.col("user_key"), True).withColumnRenamed("carry", "a")
    out = out.join(F.broadcast(before), "_range").join(F.broadcast(after), "_range")
    return out.select("user_key", F.coalesce("p", "b").alias("previous_key"), F.coalesce("x", "a").alias("next_key"))


def scan_bytes(view: DataFrame) -> DataFrame:
    return view.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("user_key") + F.octet_length(F.col("value").cast("string"))), F.lit(0)).cast("bigint").alias("bytes"))
