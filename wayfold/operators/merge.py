"""From candidates to one merged address: calibration, vote, assembly, attribution.

Candidates are ``request_id, structurer, cascade_pos, field, value,
confidence`` rows. Every step groups by ``request_id`` first, so one exchange
serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.scores import boosted, clamp, interpolate
from wayfold.functions.text import jtrim


def calibrate(candidates: DataFrame, table: DataFrame, raw: str = "raw_confidence") -> DataFrame:
    """Append ``confidence``: by the segment of (structurer, country, field), else the clamped raw value."""
    segment = table.select(F.col("structurer"), F.upper("country").alias("country"), "field", "raw_low", "raw_high", "cal_low", "cal_high")
    joined = candidates.withColumn("country", F.upper("country")).join(segment, ["structurer", "country", "field"], "left")
    bad = F.isnan(raw) | F.col(raw).isNull() | F.col(raw).isin(float("inf"), float("-inf"))
    own = interpolate(F.col(raw), F.col("raw_low"), F.col("raw_high"), F.col("cal_low"), F.col("cal_high"))
    value = F.when(bad, F.lit(0.0)).when(F.col("cal_low").isNotNull(), own).otherwise(clamp(F.col(raw)))
    return joined.withColumn("confidence", value).drop("raw_low", "raw_high", "cal_low", "cal_high")


def first_of_each(candidates: DataFrame) -> DataFrame:
    """A structurer's first value of each field, by ``pos``."""
    best = candidates.groupBy("request_id", "structurer", "field").agg(F.min(F.struct("pos", *(c for c in candidates.columns if c not in ("request_id", "structurer", "field", "pos")))).alias("one"))
    return best.select("request_id", "structurer", "field", "one.*").select(*candidates.columns)


def route(candidates: DataFrame, routing: DataFrame) -> DataFrame:
    """Keep the structurers that the country's route lists; a country without a route keeps all."""
    listed = routing.select(F.upper("country").alias("_country"), F.col("structurers").alias("_listed"))
    joined = candidates.join(listed, F.upper("country") == F.col("_country"), "left")
    open_route = F.col("_listed").isNull() | (F.size("_listed") == 0)
    return joined.where(open_route | F.array_contains("_listed", F.col("structurer"))).drop("_country", "_listed")


def candidate() -> Column:
    """What the vote compares: a struct whose order is confidence, then the earlier source; null for rows without a value."""
    return F.when(F.col("value").isNotNull() & (F.col("value") != ""), F.struct("confidence", (-F.col("cascade_pos")).alias("early"), "value", jtrim(F.lower("value")).alias("norm")))


def elected(df: DataFrame, said: str, sources: Column | None = None) -> DataFrame:
    """Append ``_won``, a struct of ``value, confidence, merge_strategy``, and ``sources`` to rows with an array of candidates.

    ``sources`` is their number where it is not that of the candidates.
    """

    def group(norm: Column) -> Column:
        own = F.filter(said, lambda x: x["norm"] == norm)
        return F.struct(F.size(own).alias("n"), F.array_max(F.transform(own, lambda x: x["early"])).alias("seen"), F.array_max(own).alias("best"))

    groups = F.transform(F.array_distinct(F.transform(said, lambda x: x["norm"])), group)
    # columns of their own, so that they are computed once
    df = df.withColumns({"_top": F.array_max(said), "_most": F.when(F.size(said) > 1, F.array_max(groups)), "sources": (F.size(said) if sources is None else sources).cast("long")})
    agreed = F.coalesce(F.col("_most.n") >= 2, F.lit(False))
    won = F.struct(
        F.when(agreed, F.col("_most.best.value")).otherwise(F.col("_top.value")).alias("value"),
        F.when(agreed, boosted(F.col("_most.best.confidence"), F.col("_most.n"))).otherwise(F.col("_top.confidence")).alias("confidence"),
        F.when(agreed, "CONSENSUS").when(F.col("sources") == 1, "SINGLE_SOURCE").otherwise("HIGHEST_CONFIDENCE").alias("merge_strategy"),
    )
    return df.withColumn("_won", won).drop("_top", "_most", said)


def vote(candidates: DataFrame) -> DataFrame:
    """Per request and field: the value most sources agree on, else the most confident one.

    Equal group sizes go to the group seen first, equal confidences to the
    earlier source. The result: ``value, confidence, merge_strategy, sources``.
    A group has as many rows as a request has sources, so its candidates are
    gathered once and compared in place.
    """
    rows = candidates.where("value is not null and value <> ''").repartition("request_id")
    said = rows.groupBy("request_id", "field").agg(F.collect_list(candidate()).alias("_said"))
    return elected(said, "_said").select("request_id", "field", "_won.*", "sources")


def assemble(merged: DataFrame) -> DataFrame:
    """One row a request with ``fields``, a map of field to (value, confidence, merge_strategy)."""
    entry = F.struct(F.col("field"), F.struct("value", "confidence", "merge_strategy"))
    return merged.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"))


def attribute(candidates: DataFrame, merged: DataFrame) -> DataFrame:
    """Every candidate with the merged value of its field and whether it was selected (case counts)."""
    won = merged.select("request_id", "field", F.col("value").alias("merged_value"))
    joined = candidates.join(won, ["request_id", "field"], "left")
    return joined.withColumn("was_selected", F.coalesce(F.col("value") == F.col("merged_value"), F.lit(False)))


def field_value(name: str, fields: str = "fields") -> Column:
    return F.try_element_at(F.col(fields), F.lit(name))["value"]


def field_confidence(name: str, fields: str = "fields") -> Column:
    return F.try_element_at(F.col(fields), F.lit(name))["confidence"]
