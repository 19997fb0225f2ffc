"""Quantiles from mergeable sketches: counts in buckets whose bounds grow by a fixed factor.

A value v > 0 falls into bucket ceil(log(v) / log(g)) with g = (1 + ERROR) / (1 - ERROR),
so the middle of its bucket is within ``ERROR`` of it, and so is the estimate of any
quantile of its exact value (nearest rank). A sketch is a table of bucket
counts, at most some two thousand a group for all doubles; sketches of hours
add up to those of days, and of countries to those of all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ERROR = 0.01
GROWTH = (1 + ERROR) / (1 - ERROR)
#: The bucket of zero and what is below; below any other bucket.
ZERO = -(1 << 20)
PERCENTS = (50, 95, 99)


def bucket(value: Column) -> Column:
    return F.when(value > 0, F.ceil(F.ln(value) / F.lit(math.log(GROWTH)))).when(value.isNotNull(), F.lit(ZERO)).cast("int")


def middle(bucket: Column) -> Column:
    """The value that stands for a bucket."""
    return F.when(bucket == ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), bucket.cast("double")) * F.lit(2 / (1 + GROWTH)))


def sketch(rows: DataFrame, value: str, *by: Column | str) -> DataFrame:
    """``by, bucket, n``; null values are left out."""
    return rows.withColumn("bucket", bucket(F.col(value).cast("double"))).where("bucket is not null").groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def hourly(rows: DataFrame, ts: str, value: str, *by: str) -> DataFrame:
    """Sketches by hour, as they are kept."""
    return sketch(rows.withColumn("hour", F.date_trunc("hour", ts)), value, "hour", *by)


def merged(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """Sketches added up to fewer groups."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, *by: str, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """``by, n, p50, ...``: the smallest bucket up to which at least that share of the values lies."""
    group = W.partitionBy(*by)
    below = F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    ranked = sketches.withColumns({"_below": below, "_all": F.sum("n").over(group)})
    return ranked.groupBy(*by).agg(F.max("_all").alias("n"), *(F.round(middle(F.min(F.when(F.col("_below") * 100 >= F.col("_all") * p, F.col("bucket")))), 6).alias(f"p{p}") for p in percents))
