"""Point reads, many at a time: current and as-of values, membership, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import PUT
from .scan import nearest


def multi_get(view: DataFrame, probes: DataFrame) -> DataFrame:
    """user_key, found, value of each probe; a missing key is a row with found false."""
    hits = view.select("user_key", "value", F.lit(True).alias("hit"))
    return probes.select("user_key").join(hits, "user_key", "left").select("user_key", F.coalesce("hit", F.lit(False)).alias("found"), "value")


def asof_get(log: DataFrame, probes: DataFrame, n: int | None = None) -> DataFrame:
    """user_key, as_of_seq, found, value: what a read at each probe's sequence sees. Versions and probes go through one
    order of key and sequence, and the last version is carried to the probes behind it."""
    asked = probes.select("user_key", F.col("as_of_seq").alias("seq")).distinct()
    seen = nearest(log, asked, ["user_key", "seq"], F.struct("user_key", "op", "value"), False, n)
    found = F.coalesce((F.col("hit.user_key") == F.col("user_key")) & (F.col("hit.op") == PUT), F.lit(False))
    return seen.select("user_key", F.col("seq").alias("as_of_seq"), found.alias("found"), F.when(found, F.col("hit.value")).alias("value"))


def members(probes: DataFrame, view: DataFrame) -> DataFrame:
    return probes.join(view.select("user_key"), "user_key", "left_semi")


def strangers(probes: DataFrame, view: DataFrame) -> DataFrame:
    return probes.join(view.select("user_key"), "user_key", "left_anti")


def fingerprint(digits: int):
    return F.substring(F.md5(F.col("user_key").cast("binary")), 1, digits)


def marks(keys: DataFrame, digits: int = 3) -> DataFrame:
    """A filter's content: each short fingerprint and how many of the keys have it."""
    return keys.groupBy(fingerprint(digits).alias("mark")).agg(F.count("*").alias("n"))


def without_marks(held: DataFrame, gone: DataFrame, digits: int = 3) -> DataFrame:
    """A filter's content after some of its keys were deleted, each of which takes one of its fingerprint's count; a
    key that was never added takes another's, as with any filter of fingerprints."""
    left = held.unionByName(marks(gone, digits).select("mark", (-F.col("n")).alias("n"))).groupBy("mark").agg(F.sum("n").alias("n"))
    return left.where("n > 0")


def candidates(probes: DataFrame, view: DataFrame, digits: int = 3) -> DataFrame:
    """Probes that a filter of short fingerprints lets through, with whether they are really there: never a miss,
    sometimes a false alarm."""
    held = marks(view, digits).select("mark")
    passed = probes.select("user_key", fingerprint(digits).alias("mark")).join(held, "mark", "left_semi").select("user_key")
    real = view.select("user_key", F.lit(True).alias("r"))
    return passed.join(real, "user_key", "left").select("user_key", F.coalesce("r", F.lit(False)).alias("present"))
