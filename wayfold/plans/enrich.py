"""The enrichment plan: candidates of a set of requests to decided results.

Merged values are normalised for CTRY only, consensus runs on fully normalised
values; a candidate carries both forms, so that one exchange by ``request_id``
serves vote, assembly and consensus. A request has few candidates: they are
gathered and compared in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import is_blank, jtrim
from wayfold.operators import consensus, decide, merge, normalize
from wayfold.operators.lookup import lookup
from wayfold.plans.config import COMPLIANCE, REVIEW_BY_COUNTRY, REVIEW_RULES, REVIEW_THRESHOLD


def assembled(candidates: DataFrame) -> DataFrame:
    """One row a request: ``country`` (the hint), ``fields`` and the consensus columns.

    ``candidates``: ``request_id, country, structurer, cascade_pos, field, value, full, confidence``.
    """
    heard = F.when(~is_blank(F.col("full")), F.struct("structurer", jtrim(F.lower("full")).alias("norm")))
    by_field = candidates.repartition("request_id").groupBy("request_id", "field").agg(F.max("country").alias("country"), F.collect_list(merge.candidate()).alias("_said"), F.collect_list(heard).alias("_heard"))
    won = merge.elected(by_field, "_said")
    entry = F.when(F.col("_won.value").isNotNull(), F.struct("field", "_won"))
    rows = won.groupBy("request_id").agg(F.max("country").alias("country"), F.array_sort(F.collect_list(entry)).alias("_entries"), F.collect_list(F.struct("field", F.col("_heard").alias("said"))).alias("_heard"))
    rows = rows.select("request_id", "country", "_heard", F.when(F.size("_entries") > 0, F.map_from_entries("_entries")).alias("fields"))
    place = F.when(F.col("country") != "", F.col("country")).otherwise(F.coalesce(F.upper(merge.field_value("CTRY")), F.lit("")))
    return rows.withColumn("_place", place).select("request_id", "country", "fields", consensus.within("_heard", F.col("_place")).alias("_c")).select("request_id", "country", "fields", "_c.*")


def structure(requests: DataFrame, candidates: DataFrame, dictionary: DataFrame, calibration: DataFrame, routing: DataFrame) -> DataFrame:
    """One row a request with ``fields``, consensus counts and ``overall_confidence``."""
    hinted = candidates.join(requests.select("request_id", F.coalesce("country_hint", F.lit("")).alias("country")), "request_id")
    routed = normalize.full_values(merge.route(hinted, routing), dictionary, "full")
    rows = assembled(merge.calibrate(normalize.country_values(routed, dictionary), calibration)).drop("country")
    return requests.join(rows, "request_id", "left").withColumn("overall_confidence", decide.overall_confidence())


def decided(structured: DataFrame, rules: tuple[dict, ...] = REVIEW_RULES, config: dict = COMPLIANCE, by_country: dict[str, float] | None = None) -> DataFrame:
    """Outcome, review and compliance columns.

    ``requires_review`` is fixed before the review rules run; ``outcome`` is
    what they make of it.
    """
    limit = F.coalesce(lookup(REVIEW_BY_COUNTRY if by_country is None else by_country, F.coalesce("country_hint", F.lit(""))), F.lit(REVIEW_THRESHOLD))
    df = structured.withColumns({"first_outcome": decide.outcome(limit), "exception_reason": decide.exception_reason(limit), "review_reasons": decide.review_reasons(rules)})
    df = df.withColumn("requires_review", F.when(F.col("first_outcome") == "SUCCESS", "N").otherwise("Y"))
    df = df.withColumn("outcome", decide.upgraded("review_reasons", "first_outcome"))
    df = df.withColumn("recommendation", decide.recommendation())
    return decide.compliance(df, config)


def enrich(requests: DataFrame, candidates: DataFrame, dictionary: DataFrame, calibration: DataFrame, routing: DataFrame, **settings) -> DataFrame:
    return decided(structure(requests, candidates, dictionary, calibration, routing), **settings)
