"""Dictionary canonicalisation of field values.

A dictionary is a DataFrame ``field, key, canonical`` with unique (field, key);
joins are left to Catalyst, which broadcasts it while it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import jtrim, tidy

WHOLE = ("CTRY", "CTRY_SUB_DVSN")
WORDS = ("STRT_NM", "BLDG_NM")


def _with(df: DataFrame, dictionary: DataFrame, key: str, out: str) -> DataFrame:
    named = dictionary.select(F.col("field").alias("_f"), F.col("key").alias("_k"), F.col("canonical").alias(out))
    return df.join(named, (df["field"] == F.col("_f")) & (df[key] == F.col("_k")), "left").drop("_f", "_k")


def country_values(candidates: DataFrame, dictionary: DataFrame, out: str = "value") -> DataFrame:
    """CTRY values trimmed and canonical, other values as they are, in ``out``."""
    is_ctry = F.col("field") == "CTRY"
    df = candidates.withColumn("_value", F.when(is_ctry, jtrim("value"))).withColumn("_key", F.lower("_value"))
    df = _with(df, dictionary.where("field = 'CTRY'"), "_key", "_canonical")
    short = F.length("_value") <= 3
    value = F.when(is_ctry, F.when(short, F.upper("_value")).otherwise(F.coalesce("_canonical", "_value"))).otherwise(F.col("value"))
    return df.withColumn(out, value).drop("_value", "_key", "_canonical")


def countries_only(candidates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Trim and canonicalise CTRY; other fields stay; CTRY values that end up empty go."""
    df = country_values(candidates, dictionary)
    return df.where((F.col("field") != "CTRY") | (F.col("value") != "")).select(*candidates.columns)


def full_values(candidates: DataFrame, dictionary: DataFrame, out: str = "value") -> DataFrame:
    """Every value tidied, then canonical by its whole or by its last, else first, word, in ``out``."""
    df = candidates.withColumn("_value", tidy("value"))
    words = F.split("_value", r"\s+")
    df = df.withColumns({"_words": words, "_whole": F.lower("_value")})
    df = df.withColumns({"_last": F.regexp_replace(F.lower(F.element_at("_words", -1)), "[.,]$", ""), "_first": F.regexp_replace(F.lower(F.element_at("_words", 1)), "[.,]$", "")})
    df = _with(df, dictionary.where(F.col("field").isin(*WHOLE)), "_whole", "_by_whole")
    by_word = dictionary.where(F.col("field").isin(*WORDS))
    df = _with(_with(df, by_word, "_last", "_by_last"), by_word, "_first", "_by_first")
    n = F.size("_words")
    value = (
        F.when(F.col("field").isin(*WHOLE) & (F.length("_value") <= 3), F.upper("_value"))
        .when(F.col("_by_whole").isNotNull(), F.col("_by_whole"))
        .when(F.col("_by_last").isNotNull(), F.array_join(F.concat(F.slice("_words", 1, n - 1), F.array("_by_last")), " "))
        .when(F.col("_by_first").isNotNull(), F.array_join(F.concat(F.array("_by_first"), F.slice("_words", 2, F.greatest(n - 1, F.lit(0)))), " "))
        .otherwise(F.col("_value"))
    )
    return df.withColumn(out, jtrim(value)).drop("_value", "_words", "_whole", "_last", "_first", "_by_whole", "_by_last", "_by_first")


def all_fields(candidates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Fully normalised candidates; values that end up empty go."""
    return full_values(candidates, dictionary).where("value <> ''").select(*candidates.columns)


def whole_values(candidates: DataFrame, dictionary: DataFrame, field: str) -> DataFrame:
    """Canonical forms of one field's whole values, such as words of direction; other values are tidied only."""
    df = candidates.withColumn("_value", tidy("value")).withColumn("_key", F.lower("_value"))
    df = _with(df, dictionary.where(F.col("field") == field), "_key", "_canonical")
    return df.withColumn("value", F.coalesce("_canonical", "_value")).select(*candidates.columns)
