"""Views of the change log as of a sequence: the newest visible version of each key, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.keys import DELETE, PUT
from .ranges import following


def newest() -> WindowSpec:
    return Window.partitionBy("user_key").orderBy(F.desc("seq"))


def visible(log: DataFrame, as_of: int | None = None) -> DataFrame:
    return log if as_of is None else log.where(F.col("seq") <= as_of)


def latest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest visible version of each key, tombstones included."""
    return visible(log, as_of).withColumn("_n", F.row_number().over(newest())).where("_n = 1").drop("_n")


def live(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Keys with a value; the tombstone test comes after the newest version is found."""
    return latest(log, as_of).where(F.col("op") == PUT).select("user_key", "seq", "value")


def live_by_max(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """live() as an aggregate, combined before the shuffle: for keys with very many versions."""
    top = F.max_by(F.struct("seq", "op", "value"), F.col("seq"))
    return visible(log, as_of).groupBy("user_key").agg(top.alias("v")).where(F.col("v.op") == PUT).select("user_key", "v.seq", "v.value")


def tombstoned(log: DataFrame, as_of: int | None = None) -> DataFrame:
    return latest(log, as_of).where(F.col("op") == DELETE).select("user_key", "seq")


def resurrected(log: DataFrame) -> DataFrame:
    """Keys that were put again right after a delete, and how often."""
    rows = following(log, [F.col("user_key"), F.col("seq")], F.struct("user_key", "op"), "_was")
    again = (F.col("_was.user_key") == F.col("user_key")) & (F.col("_was.op") == DELETE) & (F.col("op") == PUT)
    return rows.where(again).groupBy("user_key").agg(F.count("*").alias("times"))


def history(log: DataFrame) -> DataFrame:
    """Every version with its rank, newest first, and the sequence that replaced it."""
    return log.select("*", F.row_number().over(newest()).cast("bigint").alias("version"), F.lag("seq").over(newest()).alias("replaced_by"))


def version_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("user_key").agg(F.count("*").alias("versions"), F.count(F.when(F.col("op") == DELETE, 1)).alias("deletes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def difference(log: DataFrame, old: int, new: int) -> DataFrame:
    """Keys whose live value differs between two sequences."""
    a = live(log, old).select("user_key", F.col("value").alias("old_value"), F.lit(True).alias("was"))
    b = live(log, new).select("user_key", F.col("value").alias("new_value"), F.lit(True).alias("now"))
    both = a.join(b, "user_key", "full")
    return both.where(~(F.col("old_value").eqNullSafe(F.col("new_value")) & F.col("was").eqNullSafe(F.col("now")))).select("user_key", "old_value", "new_value")
