"""Idempotent claims: one result a key, across channels, batches and restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions.text import dedup_key


def with_key(requests: DataFrame) -> DataFrame:
    return requests.withColumn("idem_key", dedup_key(F.col("raw"), F.col("country_hint")))


def first_claims(requests: DataFrame) -> DataFrame:
    """Append ``claim``: 1 for the first request of a key in the batch, by arrival and correlation id."""
    order = [F.col(c).asc_nulls_last() for c in ("arrival_ts", "correlation_id", "request_id") if c in requests.columns]
    return requests.withColumn("claim", F.row_number().over(W.partitionBy("idem_key").orderBy(*order)))


def heads(requests: DataFrame) -> DataFrame:
    """The first request of each key, found by a minimum that Spark pre-aggregates: no key gathers its rows in one task."""
    order = [c for c in ("arrival_ts", "correlation_id", "request_id") if c in requests.columns]
    rest = [c for c in requests.columns if c not in (*order, "idem_key")]
    least = requests.groupBy("idem_key").agg(F.min(F.struct(*order, *rest)).alias("one"))
    return least.select("idem_key", "one.*").select(*requests.columns)


def claim(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests whose key is new: the first of the batch that the key table lacks."""
    return heads(requests).join(keys.select("idem_key").distinct(), "idem_key", "left_anti")


def resolve(requests: DataFrame, keys: DataFrame, results: DataFrame) -> DataFrame:
    """Requests of known keys with the stored result of the very key, if it is there."""
    known = requests.join(keys.select("idem_key").distinct(), "idem_key", "left_semi")
    clash = [c for c in results.columns if c in requests.columns and c != "idem_key"]
    return known.join(results.drop(*clash), "idem_key", "left").withColumn("is_duplicate", F.lit(True))


def purge(keys: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Keys that are not older than the retention."""
    return keys.where(F.col("processed_at") >= F.lit(as_of) - F.expr(f"interval {days} days"))
