"""Golden-set scoring: expected fields against structured results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import is_blank
from wayfold.operators.lookup import lookup
from wayfold.plans.config import TIER_BARS, TIER_FIXTURES, TIERS


def compare(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """Each expected field with what was found; empty expectations are left out, case does not count."""
    wanted = golden.where(~is_blank(F.col("expected"))).select("fixture_id", "country", "field", "expected")
    found = actual.select("fixture_id", "field", F.col("value").alias("actual"))
    return wanted.join(found, ["fixture_id", "field"], "left").withColumn("matched", F.coalesce(F.lower("actual") == F.lower("expected"), F.lit(False)))


def by_fixture(compared: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Share of matched fields of each fixture; -1 if nothing was expected."""
    own = compared.groupBy("fixture_id").agg(F.count("*").alias("expected_fields"), F.count_if("matched").alias("matched_fields"))
    n = F.coalesce("expected_fields", F.lit(0))
    return fixtures.join(own, "fixture_id", "left").select(
        *fixtures.columns, n.cast("long").alias("expected_fields"), F.coalesce("matched_fields", F.lit(0)).cast("long").alias("matched_fields"), F.when(n > 0, F.col("matched_fields") / n).otherwise(-1.0).alias("accuracy")
    )


def summary(scored: DataFrame) -> DataFrame:
    """The run as a whole (country is null) and by country, in one pass."""
    real = F.when(F.col("accuracy") >= 0, F.col("accuracy"))
    return scored.groupingSets([[F.col("country")], []], "country").agg(
        F.count("*").alias("total"), F.round(F.avg(real), 6).alias("mean_accuracy"), F.count_if(F.col("accuracy") == 1.0).alias("perfect"), F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"), F.count_if(F.col("outcome") == "SUCCESS").alias("successes"), F.sum("disagreements").alias("disagreements")
    )


def precision_recall(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """Per country and field: right among what was found, and among what was expected."""
    wanted = golden.where(~is_blank(F.col("expected"))).select("fixture_id", "field", "expected")
    found = actual.where(~is_blank(F.col("value"))).select("fixture_id", "field", F.col("value").alias("actual"))
    country = golden.groupBy("fixture_id").agg(F.min("country").alias("country"))
    both = wanted.join(found, ["fixture_id", "field"], "full").join(country, "fixture_id")
    right = F.count_if(F.lower("expected") == F.lower("actual"))
    return both.groupBy("country", "field").agg(F.round(right / F.nullif(F.count("actual"), F.lit(0)), 6).alias("precision"), F.round(right / F.nullif(F.count("expected"), F.lit(0)), 6).alias("recall"))


def confusion(compared: DataFrame, field: str = "CTRY") -> DataFrame:
    """Counts of (expected, actual) of one field in long form."""
    rows = compared.where(F.col("field") == field)
    return rows.groupBy(F.upper("expected").alias("expected"), F.upper(F.coalesce("actual", F.lit(""))).alias("actual")).agg(F.count("*").alias("n"))


def gates(by_country: DataFrame) -> DataFrame:
    """Whether each country meets its tier's bar; countries without a tier are in the last."""
    tier = F.coalesce(lookup(TIERS, F.col("country")), F.lit(max(TIER_BARS)))
    bar = lookup(TIER_BARS, F.col("tier"))
    return by_country.where("country is not null").withColumn("tier", tier).withColumn("bar", bar).withColumn("passed", F.col("mean_accuracy") >= F.col("bar"))


def coverage(fixtures: DataFrame) -> DataFrame:
    """Fixtures of each country against its tier's minimum."""
    tier = F.coalesce(lookup(TIERS, F.col("country")), F.lit(max(TIER_BARS)))
    return fixtures.groupBy("country").agg(F.count("*").alias("n")).withColumn("tier", tier).withColumn("least", lookup(TIER_FIXTURES, F.col("tier"))).withColumn("enough", F.col("n") >= F.col("least"))


def flat_report(scored: DataFrame, compared: DataFrame) -> DataFrame:
    """One line a fixture for a CSV file, its fields in one cell."""
    cell = F.concat_ws("=", "field", F.concat_ws("/", "expected", F.coalesce("actual", F.lit(""))))
    own = compared.groupBy("fixture_id").agg(F.array_join(F.array_sort(F.collect_list(cell)), "; ").alias("fields"))
    return scored.join(own, "fixture_id", "left")
