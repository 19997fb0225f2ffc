"""Stratified samples for review, repeatable for a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions.scores import bucket
from wayfold.plans.config import TIER_0

SIZES = {"HIGH": 4, "MID": 4, "LOW": 2}


def drawn(key: str, seed: int = 0) -> Column:
    """A pseudo-random order that any engine can repeat: the digest of key and seed."""
    return F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")), 256)


def first_n(df: DataFrame, by: list[str], order: list[Column], n: Column | int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps only n a task before it shuffles (window group limit)."""
    limit = n if isinstance(n, Column) else F.lit(n)
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= limit).drop("_place")


def for_review(results: DataFrame, as_of: Column, seed: int = 0, countries: tuple[str, ...] = TIER_0) -> DataFrame:
    """Of the last day and each first-tier country: 4 confident, 4 middling and 2 poor results."""
    day = results.where(F.col("country").isin(*countries) & F.col("created_at").between(as_of - F.expr("interval 1 day"), as_of))
    day = day.withColumn("confidence_bucket", bucket(F.col("overall_confidence")))
    size = F.when(F.col("confidence_bucket") == "LOW", SIZES["LOW"]).otherwise(SIZES["HIGH"])
    most = first_n(day, ["country", "confidence_bucket"], [drawn("result_id", seed), F.col("result_id")], max(SIZES.values()))
    place = F.row_number().over(W.partitionBy("country", "confidence_bucket").orderBy(drawn("result_id", seed), "result_id"))
    return most.withColumn("_place", place).where(F.col("_place") <= size).select("result_id", "country", "confidence_bucket", F.lit("PENDING").alias("status"), F.lit(0).alias("version"))


def per_country(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` pseudo-random rows of each country."""
    return first_n(df, ["country"], [drawn(key, seed), F.col(key)], n)


def of_active(addresses: DataFrame, parties: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` pseudo-random addresses of active parties of each country."""
    return per_country(addresses.join(parties.where("status = 'ACTIVE'").select("party_id"), "party_id", "left_semi"), n, key, seed)
