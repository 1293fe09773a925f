"""Immutable sorted segments: cutting the log, the manifest of key ranges, stabs, overlaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import carried, ranged, running_sum, summed_before
from .scan import nearest


def cut(log: DataFrame, size: int = 500) -> DataFrame:
    """Segments of `size` consecutive operations."""
    return log.withColumn("segment_id", F.floor((F.col("seq") - 1) / size).cast("bigint"))


def manifest(segments: DataFrame) -> DataFrame:
    """One row a segment: its closed range of internal keys, newest stamp and entries."""
    inner = F.struct("user_key", (-F.col("seq")).alias("newest"), F.col("seq").alias("seq"))
    rows = segments.groupBy("segment_id").agg(F.min(inner).alias("inf"), F.max(inner).alias("sup"), F.max("seq").alias("stamp"), F.count("*").alias("n_entries"))
    return rows.select("segment_id", F.col("inf.user_key").alias("inf_key"), F.col("inf.seq").alias("inf_seq"), F.col("sup.user_key").alias("sup_key"), F.col("sup.seq").alias("sup_seq"), "stamp", "n_entries")


def stats(m: DataFrame) -> DataFrame:
    return m.agg(F.count("*").alias("segments"), F.coalesce(F.sum("n_entries"), F.lit(0)).cast("bigint").alias("entries"), F.min("inf_key").alias("first_key"), F.max("sup_key").alias("last_key"))


def stab(m: DataFrame, probes: DataFrame, n: int | None = None) -> DataFrame:
    """probe, segment_id, stamp: the segments whose key range covers each probe. Both sides are dealt to ranges of the
    key order, each interval copied to the ranges that it spans."""
    asked, spans = probes.select(F.col("user_key").alias("probe")), m.select("segment_id", "stamp", "inf_key", "sup_key")
    points = asked.select(F.col("probe").alias("p"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("segment_id"))
    ends = spans.select(F.explode(F.array("inf_key", "sup_key")).alias("p"), F.lit(1).alias("kind"), "segment_id")
    dealt = ranged(points.unionByName(ends), [F.col("p")], n or int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    reach = dealt.where("kind = 1").groupBy("segment_id").agg(F.min("_range").alias("a"), F.max("_range").alias("b"))
    wide = spans.join(reach, "segment_id").withColumn("_range", F.explode(F.sequence("a", "b")))
    covers = F.col("probe").between(F.col("inf_key"), F.col("sup_key"))
    return dealt.where("kind = 0").select(F.col("p").alias("probe"), "_range").join(wide, "_range").where(covers).select("probe", "segment_id", "stamp")


def newest_first(stabbed: DataFrame) -> DataFrame:
    """A stab's segments in the order in which a read asks them: rank 1 is the newest stamp; ties to the greater id."""
    return stabbed.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("stamp"), F.desc("segment_id"))))


def windows(m: DataFrame, probes: DataFrame, n: int | None = None) -> DataFrame:
    """probe, left_key, right_key, overlaps: the nearest end of a segment below each probe, the nearest start of one above
    it (null where there is none), and how many segments cover it: where a scan must look for segments again."""
    asked = probes.select("user_key").distinct()
    ends, starts = (m.select(F.col(c).alias("user_key"), F.lit(at).alias("at")).distinct() for c, at in (("sup_key", 1), ("inf_key", 0)))
    left = nearest(ends, asked.withColumn("at", F.lit(0)), ["user_key", "at"], F.struct("user_key"), False, n)
    right = nearest(starts, asked.withColumn("at", F.lit(1)), ["user_key", "at"], F.struct("user_key"), True, n)
    out = left.select("user_key", F.col("hit.user_key").alias("left_key")).join(right.select("user_key", F.col("hit.user_key").alias("right_key")), "user_key")
    return out.withColumnRenamed("user_key", "probe").join(overlap_counts(m, asked, n), "probe")


def next_starts(m: DataFrame, probes: DataFrame, border: str, latest: int, n: int | None = None) -> DataFrame:
    """probe, right_key: the nearest start above each probe of a segment with a stamp of `latest` or less, below the
    border; null where there is none."""
    found = windows(m.where((F.col("stamp") <= latest) & (F.col("inf_key") < border)), probes, n)
    return found.select("probe", "right_key")


def containing(m: DataFrame, ranges: DataFrame, n: int | None = None) -> DataFrame:
    """lo, hi, segment_id: the segments whose closed key range holds all of each range (lo, hi)."""
    asked = ranges.select("lo", "hi").distinct()
    hit = stab(m, asked.select(F.col("lo").alias("user_key")).distinct(), n)
    ends = m.select("segment_id", "sup_key")
    return asked.join(hit, asked.lo == hit.probe).join(ends, "segment_id").where(F.col("hi") <= F.col("sup_key")).select("lo", "hi", "segment_id")


def _ends(m: DataFrame) -> DataFrame:
    """Both ends of each segment: starts (kind 0) raise the overlap, ends (kind 2) lower it behind them."""
    ends = lambda key, kind, delta: m.select(F.col(key).alias("point"), F.lit(kind).alias("kind"), "stamp", F.lit(delta).alias("delta"))
    return ends("inf_key", 0, 1).unionByName(ends("sup_key", 2, -1))


def overlap_counts(m: DataFrame, probes: DataFrame, n: int | None = None) -> DataFrame:
    """probe, overlaps: how many segments cover each, by one sweep over ends and probes; no pair is made."""
    asked = probes.select(F.col("user_key").alias("point")).distinct().select("point", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("stamp"), F.lit(0).alias("delta"))
    swept = running_sum(_ends(m).unionByName(asked), [F.col("point"), F.col("kind"), F.col("stamp")], F.col("delta"), "overlaps", n)
    return swept.where("kind = 1").select(F.col("point").alias("probe"), "overlaps")


def mountains(m: DataFrame, n: int | None = None) -> DataFrame:
    """Height of the overlap along the end points: starts count before, ends after a point."""
    out = running_sum(_ends(m), [F.col("point"), F.col("kind"), F.col("stamp")], F.col("delta"), "height", n)
    kind = F.when(F.col("kind") == 2, 1).otherwise(0)
    return out.select("point", kind.alias("kind"), "stamp", (F.col("height") + kind).cast("bigint").alias("height"))


def islands(m: DataFrame, n: int | None = None) -> DataFrame:
    """The manifest with the number of the connected run of overlapping ranges that each segment is in."""
    order = [F.col("inf_key"), F.col("sup_key"), F.col("segment_id")]
    rows = ranged(m, order, n)
    w = Window.partitionBy("_range").orderBy(*order)
    rows = rows.withColumn("_here", F.max("sup_key").over(w.rowsBetween(Window.unboundedPreceding, -1))).join(F.broadcast(carried(rows, F.col("sup_key"), False)), "_range")
    # the greatest end so far: in this range or in those before it
    before = F.greatest("_here", "carry")
    rows = rows.withColumn("_new", F.when(before.isNull() | (before < F.col("inf_key")), 1).otherwise(0)).drop("_here", "carry")
    here = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("_here", here).join(F.broadcast(summed_before(rows, F.col("_new"))), "_range")
    return out.withColumn("island", (F.col("_here") + F.col("before")).cast("bigint")).drop("_new", "_here", "before", "_range")


def compaction_pick(m: DataFrame, max_overlap: int = 2) -> DataFrame:
    """Islands of at least max_overlap segments: what is due."""
    return islands(m).groupBy("island").agg(F.count("*").alias("segments"), F.min("inf_key").alias("left_key"), F.max("sup_key").alias("right_key"), F.max("stamp").alias("stamp"), F.sum("n_entries").cast("bigint").alias("entries")).where(F.col("segments") >= max_overlap)
