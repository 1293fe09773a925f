"""Latency histograms: fixed buckets, mergeable counts, interpolated percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limits() -> list[float]:
    """Upper bounds of the buckets: one to nine, then sixteen steps a decade up to 9e9, and one for all the rest."""
    steps = [10, 12, 14, 16, 18, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90]
    return [float(x) for x in [*range(1, 10), *(s * 10**d for d in range(9) for s in steps)]] + [1e200]


# Fixed values.
LIMITS = limits()


def bucket(value: Column) -> Column:
    """Number of the first bucket whose bound lies above the value; the last one takes what is left."""
    over = F.filter(F.array(*map(F.lit, LIMITS)), lambda x: x <= value)
    return F.least(F.size(over), F.lit(len(LIMITS) - 1)).cast("int")


def counts(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Partial histogram: by, bucket, n, low, high. Adding up n, least low and greatest high merges two of them."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _bounds(b: Column) -> tuple[Column, Column]:
    bounds = F.array(*map(F.lit, [0.0, *LIMITS]))
    return F.element_at(bounds, b + 1), F.element_at(bounds, b + 2)


def table(parts: DataFrame, *by: str) -> DataFrame:
    """Rows of the printed histogram: bounds, n, percent, cumulative percent and a bar of twenty marks."""
    part = Window.partitionBy(*by)
    total, run = F.sum("n").over(part), F.sum("n").over(part.orderBy("bucket"))
    left, right = _bounds(F.col("bucket"))
    bar = F.repeat(F.lit("#"), (F.lit(20.0) * F.col("n") / total + 0.5).cast("int"))
    return merged(parts, *by).select(*by, "bucket", left.alias("low_bound"), right.alias("high_bound"), "n", (100.0 * F.col("n") / total).alias("percent"), (100.0 * run / total).alias("cumulative"), bar.alias("bar"))


def percentiles(parts: DataFrame, wanted: list[float], *by: str) -> DataFrame:
    """by, p, value: linear inside the bucket that holds the rank, kept within the least and greatest value."""
    part = Window.partitionBy(*by)
    rows = merged(parts, *by).select(*by, "bucket", "n", F.sum("n").over(part).alias("total"), F.sum("n").over(part.orderBy("bucket")).alias("run"), F.min("low").over(part).alias("least"), F.max("high").over(part).alias("most"))
    rows = rows.select("*", F.explode(F.array(*[F.lit(float(p)) for p in wanted])).alias("p"))
    rank = F.col("total") * (F.col("p") / 100.0)
    left, right = _bounds(F.col("bucket"))
    hit = rows.where((F.col("run") >= rank) & (F.col("run") - F.col("n") < rank))
    value = left + (right - left) * ((rank - (F.col("run") - F.col("n"))) / F.col("n"))
    return hit.select(*by, "p", F.least(F.greatest(value, F.col("least")), F.col("most")).alias("value"))


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, average (0 if empty), population standard deviation, least and greatest value."""
    c = F.col(value)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.coalesce(F.avg(c), F.lit(0.0)).alias("average"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("deviation"), F.min(c).alias("least"), F.max(c).alias("most"))
