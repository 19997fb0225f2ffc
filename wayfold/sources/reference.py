"""Reference data from text files: dictionaries, sets, patterns, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.text import jtrim

CALIBRATION = "structurer string, country string, field string, raw_low double, raw_high double, cal_low double, cal_high double"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, said``: lines are ordered by the block that they stand in, then by their place there, so a large file is read by many tasks."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), place.alias("line"), F.col("value").alias("said"))
    return rows.withColumn("said", jtrim(F.col("said"))).where("said <> '' and not startswith(said, '#')")


def dictionary(spark: SparkSession, path: str, field: str) -> DataFrame:
    """``field, key, canonical`` from lines ``canonical|synonym|...``; the first definition (file, then line) wins."""
    words = F.transform(F.split("said", r"\|"), jtrim)
    rows = _lines(spark, path).withColumn("words", words).select("file", "line", F.element_at("words", 1).alias("canonical"), F.posexplode("words").alias("pos", "word")).where("word <> ''")
    least = rows.groupBy(F.lower("word").alias("key")).agg(F.min(F.struct("file", "line", "pos", "canonical")).alias("one"))
    return least.select(F.lit(field).alias("field"), "key", "one.canonical")


def country_set(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.upper("said").alias("country")).distinct()


def patterns(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.col("said").alias("pattern"))


def calibration(spark: SparkSession, path: str, structurer: str) -> DataFrame:
    """Segments from a CSV file with comment lines before its header."""
    rows = _lines(spark, path).where(~F.lower("said").startswith("country,"))
    parts = F.split("said", r"\s*,\s*")
    cells = rows.where(F.size(parts) >= 6).select(parts.alias("p"))
    return cells.select(F.lit(structurer).alias("structurer"), F.upper(F.get("p", F.lit(0))).alias("country"), F.get("p", F.lit(1)).alias("field"), *(F.get("p", F.lit(k + 2)).cast("double").alias(n) for k, n in enumerate(("raw_low", "raw_high", "cal_low", "cal_high"))))


def prompt_supplements(spark: SparkSession, path: str) -> DataFrame:
    """``country, supplement`` from files named by country."""
    rows = spark.read.text(path, wholetext=True).select(F.upper(F.regexp_extract("_metadata.file_path", r"([^/]+)\.[a-z]+$", 1)).alias("country"), F.col("value").alias("supplement"))
    return rows
