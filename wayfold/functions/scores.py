"""Confidence arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column) -> Column:
    """Into [0, 1]; null, NaN and infinities count as 0."""
    bad = c.isNull() | F.isnan(c) | (c == float("inf")) | (c == float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def interpolate(raw: Column, raw_low: Column, raw_high: Column, low: Column, high: Column) -> Column:
    """Linear between the bounds, flat outside them."""
    share = (raw - raw_low) / F.when(raw_high > raw_low, raw_high - raw_low)
    return F.when(raw <= raw_low, low).when(raw >= raw_high, high).otherwise(low + share * (high - low))


def boosted(c: Column, sources: Column) -> Column:
    """A tenth more for each source beyond the first, at most 1."""
    return F.least(F.lit(1.0), c * (1.0 + 0.1 * (sources - 1)))


def tenth(c: Column) -> Column:
    """The tenth that a confidence falls into; decimals keep 0.29 * 10 exact."""
    return (F.floor(c.cast("decimal(3,2)") * 10) / 10).cast("decimal(2,1)")


def bucket(c: Column) -> Column:
    return F.when(c >= 0.9, "HIGH").when(c >= 0.7, "MID").otherwise("LOW")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole difference in seconds, hours included."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
