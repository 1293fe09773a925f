"""Workloads: generated change logs and probes, and operation statistics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import DELETE, PUT, int_key, lcg

# The characters of keys that try the edges of byte order.
EDGES = b"\x00\x01abcde\xfd\xfe\xff"


def value_of(seq, size: int = 100, ratio: float = 0.5):
    """A text of `size` characters that compresses to about `ratio`: one random piece, repeated."""
    piece = max(1, int(size * ratio))
    raw = F.concat(*[F.md5(F.concat_ws("-", seq.cast("string"), F.lit(str(i)))) for i in range(-(-piece // 32))])
    return F.substring(F.repeat(F.substring(raw, 1, piece), -(-size // piece)), 1, size)


def fill(spark: SparkSession, n: int, mode: str = "seq", size: int = 100, base: int = 0) -> DataFrame:
    """n puts: ascending keys (seq), or keys drawn with repeats (random)."""
    ids = spark.range(n)
    key = F.col("id") if mode == "seq" else lcg(F.col("id") + 1) % n
    return ids.select(int_key(key).alias("user_key"), (F.col("id") + 1 + base).alias("seq"), F.lit(PUT).alias("op"), value_of(F.col("id"), size).alias("value"))


def delete_wave(log: DataFrame, base: int) -> DataFrame:
    return log.select("user_key", (F.col("seq") + base).alias("seq"), F.lit(DELETE).alias("op"), F.lit(None).cast("string").alias("value"))


def probes(spark: SparkSession, n: int, kind: str = "random", keys: int | None = None) -> DataFrame:
    """Probe keys: random ones, those of the first hundredth (hot), or ones that are never there (missing)."""
    keys = keys or n
    drawn = lcg(F.col("id") + 1, 999) % F.lit(-(-keys // 100) if kind == "hot" else keys)
    key = int_key(drawn)
    return spark.range(n).select((F.concat(key, F.lit(".")) if kind == "missing" else key).alias("user_key"))


def draws(spark: SparkSession, n: int) -> DataFrame:
    """The first n draws of the multiplicative generator, and what is made of each: a number in [0, 100), and whether a
    chance of one in ten came true."""
    rows = spark.range(1, n + 1).select("id", lcg(F.col("id")).alias("draw"))
    return rows.select("id", "draw", (F.col("draw") % 100).alias("uniform"), (F.col("draw") % 10 == 0).alias("one_in_ten"))


def skewed(spark: SparkSession, n: int, most: int = 10) -> DataFrame:
    """n numbers below 2^most of which small ones are likelier: one draw says how many bits, the next fills them."""
    bits = lcg(2 * F.col("id") - 1) % (most + 1)
    return spark.range(1, n + 1).select("id", (lcg(2 * F.col("id")) % F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int"))).alias("skewed"))


def _characters(spark: SparkSession, n: int, size: int, of) -> DataFrame:
    """id and text of n strings, each of `size` consecutive draws."""
    rows = spark.range(n * size).select(F.floor(F.col("id") / size).alias("at"), "id", of(lcg(F.col("id") + 1)).alias("c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "c"))), lambda x: x["c"]), "")
    return rows.groupBy("at").agg(joined.alias("text")).select(F.col("at").alias("id"), "text")


def random_strings(spark: SparkSession, n: int, size: int) -> DataFrame:
    """Strings of printable characters."""
    return _characters(spark, n, size, lambda draw: F.chr(32 + draw % 95))


def edge_keys(spark: SparkSession, n: int, size: int) -> DataFrame:
    """Binary keys of bytes that lie at the edges of byte order."""
    digits = F.array(*[F.lit(f"{b:02X}") for b in EDGES])
    return _characters(spark, n, size, lambda draw: F.get(digits, (draw % len(EDGES)).cast("int"))).select("id", F.unhex("text").alias("text"))


def merged_stats(runs: DataFrame) -> DataFrame:
    """One row a benchmark of its threads' runs (name, started and finished in seconds, seconds, ops, bytes): micros an
    operation by the threads' own time, megabytes a second by the time from the first start to the last finish."""
    wall = F.max("finished") - F.min("started")
    out = runs.groupBy("name").agg(F.sum("ops").cast("bigint").alias("ops"), F.sum("bytes").cast("bigint").alias("bytes"), F.sum("seconds").alias("seconds"), wall.alias("wall"))
    return out.select("name", "ops", "bytes", (1e6 * F.col("seconds") / F.greatest(F.col("ops"), F.lit(1))).alias("micros_per_op"), F.when(F.col("wall") > 0, F.col("bytes") / 1048576 / F.col("wall")).alias("mb_per_s"))


def timed(name: str, ops: int, job: Callable[[], object], n_bytes: int = 0) -> dict:
    """Microseconds an operation, and megabytes a second on the wall clock."""
    began = time.perf_counter()
    job()
    s = time.perf_counter() - began
    return {"name": name, "ops": ops, "micros_per_op": 1e6 * s / max(ops, 1), "mb_per_s": n_bytes / 1048576 / s}
