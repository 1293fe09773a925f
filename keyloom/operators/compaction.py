"""Rewrites that no live snapshot can tell: garbage collection and the manifest's exchange of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.keys import DELETE
from . import segments
from .ranges import following, ranged


def marked(log: DataFrame, smallest_snapshot: int) -> DataFrame:
    """dropped: a newer version of the key is visible to every live snapshot. Tombstones follow the same rule. The log is
    read in key order over ranges, so a key with very many versions is no single task's work."""
    rows = following(log, [F.col("user_key"), -F.col("seq")], F.struct("user_key", "seq"), "_newer")
    newer = F.when(F.col("_newer.user_key") == F.col("user_key"), F.col("_newer.seq"))
    return rows.withColumn("dropped", F.coalesce(newer <= smallest_snapshot, F.lit(False))).drop("_newer")


def kept(log: DataFrame, smallest_snapshot: int) -> DataFrame:
    return marked(log, smallest_snapshot).where(~F.col("dropped")).drop("dropped")


def drop_counts(log: DataFrame, smallest_snapshot: int) -> DataFrame:
    m = marked(log, smallest_snapshot)
    return m.agg(F.count("*").alias("read"), F.count(F.when(F.col("dropped"), 1)).alias("dropped"), F.count(F.when(~F.col("dropped"), 1)).alias("written"))


def purged(log: DataFrame, smallest_snapshot: int) -> DataFrame:
    """kept(), without tombstones that have nothing left to hide. Only sound over all segments that hold their keys."""
    newest = F.row_number().over(Window.partitionBy("user_key").orderBy(F.desc("seq"))) == 1
    out = kept(log, smallest_snapshot).withColumn("_newest", newest)
    return out.where(~(F.col("_newest") & (F.col("op") == DELETE) & (F.col("seq") <= smallest_snapshot))).drop("_newest")


def rewritten(log: DataFrame, smallest_snapshot: int, size: int, first_id: int = 0, n: int | None = None) -> DataFrame:
    """What is kept, in segments of `size` entries of the whole order that don't overlap: a key's versions stay together,
    where its newest falls (so an id is left out behind a key that fills more than a segment).

    Rows are dealt to ranges once. In a range the first row counts as kept; its ends and totals, one row a range, then
    tell what the ranges before it hold, whether they have a newer version of that first row, and where its key began.
    Ends need no order in the range: for a result without segment_id they are found before anything else is dealt.
    """
    w = Window.partitionBy("_range").orderBy("user_key", F.desc("seq"))
    so_far, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged(log, [F.col("user_key"), -F.col("seq")], n)
    rows = rows.withColumn("_newer", F.lag(F.struct("user_key", "seq")).over(w))
    starts = F.col("_newer").isNull() | (F.col("_newer.user_key") != F.col("user_key"))
    rows = rows.withColumn("_starts", starts).withColumn("_gone", ~starts & (F.col("_newer.seq") <= smallest_snapshot))
    rows = rows.withColumn("_at", F.sum((~F.col("_gone")).cast("bigint")).over(so_far))
    # a key's rank is one more than the kept rows before it, so all its versions get the same cut
    rows = rows.withColumn("_rank", F.max(F.when(F.col("_starts"), F.col("_at"))).over(so_far))
    last = F.struct("user_key", (-F.col("seq")).alias("back"))
    edges = rows.groupBy("_range").agg(F.min("user_key").alias("_first"), F.max(last).alias("_last"), *[F.max(c).alias(c) for c in ("_at", "_rank")])
    edges = edges.withColumn("_newest", F.lag("_last").over(Window.orderBy("_range"))).withColumn("_goes_on", F.coalesce(F.col("_newest.user_key") == F.col("_first"), F.lit(False)))
    edges = edges.withColumn("_less", (F.col("_goes_on") & (-F.col("_newest.back") <= smallest_snapshot)).cast("bigint"))
    edges = edges.withColumn("_before", F.coalesce(F.sum(F.col("_at") - F.col("_less")).over(before), F.lit(0)) - F.col("_less"))
    began = F.when(~F.col("_goes_on") | (F.col("_last.user_key") != F.col("_first")), F.col("_before") + F.col("_rank"))
    edges = edges.withColumn("_began", F.max(began).over(before)).select("_range", "_first", "_goes_on", "_less", "_before", "_began")
    out = rows.where(~F.col("_gone")).join(F.broadcast(edges), "_range").where(F.col("_newer").isNotNull() | (F.col("_less") == 0))
    rank = F.when(F.col("_goes_on") & (F.col("user_key") == F.col("_first")), F.col("_began")).otherwise(F.col("_before") + F.col("_rank"))
    return out.select(*log.columns, (F.floor((rank - 1) / size) + first_id).cast("bigint").alias("segment_id"))


def manifest_after(m: DataFrame, old_ids: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest without the old segments and with the new ones: one commit, never both."""
    return m.join(old_ids.select("segment_id"), "segment_id", "left_anti").unionByName(new)


def compact_all(log: DataFrame, smallest_snapshot: int, size: int = 500) -> tuple[DataFrame, DataFrame]:
    """New segments of the whole log, and their manifest, stored; stamps are those of the newest entry."""
    out = rewritten(log, smallest_snapshot, size)
    return out, durable(segments.manifest(out))
