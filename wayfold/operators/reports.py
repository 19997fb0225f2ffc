"""Reports over the persisted tables. ``as_of`` stands in for the clock; nulls sort as the largest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions.scores import seconds_between, tenth

VERDICTS = "map<string,struct<verdict:string,should_be:string>>"


def latest(df: DataFrame, ts: str) -> Column:
    """The newest time of a table as a scalar subquery: no clock, no collect."""
    return df.select(F.max(ts)).scalar()


def _since(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return df.where(F.col(ts) > as_of - F.expr(f"interval {days} days"))


def share(condition: Column, places: int = 3) -> Column:
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), places)


def daily_accuracy(samples: DataFrame, as_of: Column) -> DataFrame:
    rows = _since(samples.where("status = 'REVIEWED'"), "reviewed_at", as_of, 30)
    each = rows.select("country", F.explode(F.from_json("per_field_verdict", VERDICTS)).alias("field", "v"))
    right = F.col("v.verdict") == "correct"
    return each.groupBy("country", "field").agg(F.count("*").alias("samples_reviewed"), F.count_if(right).alias("correct"), share(right).alias("accuracy")).orderBy(F.asc_nulls_last("country"), F.asc_nulls_last("field"))


def contribution(attributions: DataFrame, as_of: Column) -> DataFrame:
    rows = _since(attributions.where("was_selected = 'Y'"), "created_at", as_of, 7)
    out = rows.groupBy("country", "field", "structurer").agg(
        F.count("*").alias("times_selected"), F.round(F.avg("calibrated_confidence"), 3).cast("double").alias("avg_calibrated_conf"), F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms")
    )
    return out.orderBy(F.asc_nulls_last("country"), F.asc_nulls_last("field"), F.desc_nulls_first("times_selected"))


def winners(attributions: DataFrame, as_of: Column, field: str, country: str) -> DataFrame:
    """Which source wins one field in one country."""
    return contribution(attributions.where((F.col("field") == field) & (F.col("country") == country)), as_of)


def confidence_histogram(results: DataFrame, as_of: Column) -> DataFrame:
    rows = _since(results, "created_at", as_of, 7)
    return rows.groupBy("country", tenth(F.col("overall_confidence")).alias("conf_bucket")).agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last("country"), F.asc_nulls_last("conf_bucket"))


def correction_rate(feedback: DataFrame, as_of: Column) -> DataFrame:
    rows = _since(feedback, "corrected_at", as_of, 14)
    n, d = F.count("*"), F.countDistinct("result_id")
    return rows.groupBy("country", "field").agg(d.alias("results_reviewed"), n.alias("total_corrections"), F.round(n / F.nullif(d, F.lit(0)), 3).alias("corrections_per_review")).orderBy(F.asc_nulls_last("country"), F.desc_nulls_first("corrections_per_review"))


def weekly_accuracy(samples: DataFrame, as_of: Column, fields: tuple[str, ...] = ("CTRY", "TWN_NM", "STRT_NM", "PST_CD")) -> DataFrame:
    rows = _since(samples.where("status = 'REVIEWED'"), "reviewed_at", as_of, 84)
    said = {f: F.get_json_object("per_field_verdict", f"$.{f}.verdict") for f in fields}
    week = F.to_date(F.date_trunc("week", "reviewed_at")).alias("week_starting")
    return rows.groupBy(week, "country").agg(F.count("*").alias("samples"), *(share(F.coalesce(v == "correct", F.lit(False))).alias(f"{f.lower()}_acc") for f, v in said.items())).orderBy(F.desc_nulls_first("week_starting"), F.asc_nulls_last("country"))


def exception_rate(results: DataFrame, as_of: Column) -> DataFrame:
    rows = _since(results, "created_at", as_of, 14)
    sent = F.col("requires_review") == "Y"
    return rows.groupBy(F.to_date("created_at").alias("date"), "country").agg(F.count("*").alias("total_processed"), F.count_if(sent).alias("sent_to_exception"), share(sent).alias("exception_rate")).orderBy(F.desc_nulls_first("date"), F.asc_nulls_last("country"))


def compliance_routing(routing: DataFrame, as_of: Column) -> DataFrame:
    """Latency counts whole seconds between the times, hours included."""
    rows = _since(routing.where("status = 'RESOLVED'"), "created_at", as_of, 7)
    said = F.col("compliance_verdict")
    return (
        rows.groupBy("country", "decision", "primary_reason")
        .agg(
            F.count("*").alias("routings"),
            share(said == "PASS").alias("pass_rate"),
            share(said == "REJECT").alias("reject_rate"),
            share(said == "NEEDS_REVIEW").alias("needs_review_rate"),
            F.round(F.avg(seconds_between(F.col("routed_at"), F.col("responded_at"))), 1).alias("avg_latency_sec"),
        )
        .orderBy(F.asc_nulls_last("country"), F.desc_nulls_first("routings"))
    )


def compliance_short(routing: DataFrame, as_of: Column) -> DataFrame:
    rows = _since(routing.where("status = 'RESOLVED'"), "created_at", as_of, 7)
    return rows.groupBy("country", "decision").agg(F.count("*").alias("routings"), share(F.col("compliance_verdict") == "PASS").alias("pass_rate")).orderBy(F.asc_nulls_last("country"), F.asc_nulls_last("decision"))


def tallies(results: DataFrame) -> DataFrame:
    """Backfill tallies by outcome."""
    return results.groupBy("outcome").agg(F.count("*").alias("n"))


def metrics(results: DataFrame) -> DataFrame:
    """Processed, duplicate and exception counts and latency by channel and outcome."""
    return results.groupBy("source_channel", "outcome").agg(
        F.count("*").alias("processed"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count("exception_reason").alias("exceptions"),
        F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )


def exceptions(results: DataFrame) -> DataFrame:
    """Exceptions by reason and country."""
    return results.where("exception_reason is not null").groupBy("exception_reason", "country").agg(F.count("*").alias("n"))


def latencies(calls: DataFrame, *by: str) -> DataFrame:
    """Calls and their latency, by source and country or by channel and outcome."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))


def distribution(attributions: DataFrame) -> DataFrame:
    """Confidence by source, field and country: count, mean, tenths, and how often the raw value was kept."""
    c = F.col("calibrated_confidence")
    return attributions.groupBy("structurer", "field", "country").agg(
        F.count("*").alias("n"), F.round(F.avg(c), 6).cast("double").alias("mean"), *(F.count_if(tenth(c) == x / 10).alias(f"b{x}") for x in range(0, 11, 5)), F.count_if(c == F.col("raw_confidence")).alias("fallbacks")
    )


def usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and latency by source and model."""
    return calls.groupBy("structurer", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))


def week_triggers(weekly: DataFrame, drop: float = 0.05, bar: float = 0.80) -> DataFrame:
    """Weeks in which accuracy fell by more than ``drop``, or stayed below ``bar`` for the second week."""
    by = W.partitionBy("country").orderBy(F.asc_nulls_last("week_starting"))
    before = F.lag("accuracy").over(by)
    both = F.max("accuracy").over(by.rowsBetween(-1, 0))
    out = weekly.withColumns({"previous": before, "_worst": both})
    return out.select(
        "country", "week_starting", "accuracy", "previous", F.coalesce(F.col("previous") - F.col("accuracy") > drop, F.lit(False)).alias("dropped"), (F.col("previous").isNotNull() & (F.col("_worst") < bar)).alias("low_for_two_weeks")
    )


def win_rate_triggers(weekly: DataFrame, drop: float = 0.20) -> DataFrame:
    """Weeks in which a source's share of selections fell by more than ``drop``; ``weekly``: country, structurer, week_starting, selected, total."""
    rate = F.col("selected") / F.col("total")
    before = F.lag(rate).over(W.partitionBy("country", "structurer").orderBy(F.asc_nulls_last("week_starting")))
    return weekly.select("country", "structurer", "week_starting", rate.alias("win_rate"), before.alias("previous"), F.coalesce(before - rate > drop, F.lit(False)).alias("dropped"))


def median_shift(attributions: DataFrame, split: Column, shift: float = 0.10) -> DataFrame:
    """Sources whose median confidence moved by more than ``shift`` across a point in time.

    Confidences have two places, so the exact median counts a hundred values a group.
    """
    late, c = F.col("created_at") >= split, F.col("calibrated_confidence").cast("double")
    medians = attributions.groupBy("structurer", "country").agg(F.round(F.median(F.when(~late, c)), 6).alias("before"), F.round(F.median(F.when(late, c)), 6).alias("after"))
    return medians.withColumn("shifted", F.coalesce(F.abs(F.col("after") - F.col("before")) > shift + 1e-9, F.lit(False)))


def stale_reviewers(samples: DataFrame, as_of: Column, least: int = 30, days: int = 30) -> DataFrame:
    """Countries with fewer than ``least`` reviewed samples in the last days, with zero for those without any."""
    recent = (F.col("status") == "REVIEWED") & (F.col("reviewed_at") > as_of - F.expr(f"interval {days} days"))
    return samples.groupBy("country").agg(F.count_if(recent).alias("reviewed")).where(F.col("reviewed") < least)
