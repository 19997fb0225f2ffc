"""What a batch of decided results writes: tables, documents and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.merge import field_value

#: Files of a day at most: a day that holds most rows is still written by several tasks.
FILES_A_DAY = 8
FIELD_MAP = "map<string,struct<value:string,confidence:double,merge_strategy:string>>"


def result_rows(results: DataFrame, created_at: Column) -> DataFrame:
    """Rows of the results table: fields and trace as JSON, confidence as a decimal, the flag as Y or N."""
    return results.select(
        F.xxhash64("idem_key").alias("result_id"),
        "idem_key",
        "correlation_id",
        "source_channel",
        F.col("country_hint").alias("country"),
        F.to_json("fields").alias("fields_json"),
        F.to_json(F.struct("agreements", "disagreements", "source_count", "flagged_fields", "weights")).alias("trace_json"),
        F.col("overall_confidence").cast("decimal(3,2)").alias("overall_confidence"),
        "requires_review",
        "outcome",
        created_at.alias("created_at"),
    )


def decode(rows: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Stored rows with ``fields`` again; unknown fields are skipped, a blank text is an empty map."""
    body = F.coalesce(F.from_json(F.nullif("fields_json", F.lit("")), FIELD_MAP), F.from_json(F.lit("{}"), FIELD_MAP))
    return rows.withColumn("fields", F.map_filter(body, lambda k, v: k.isin(*known)))


def exception_rows(results: DataFrame, created_at: Column) -> DataFrame:
    return results.where("exception_reason is not null").select(
        F.xxhash64("idem_key").alias("item_id"), "correlation_id", F.col("country_hint").alias("country"), F.col("exception_reason").alias("reason"), F.lit("OPEN").alias("status"), F.lit(1).alias("version"), F.lit(None).cast("string").alias("assigned_to"), created_at.alias("created_at")
    )


def attribution_rows(attributed: DataFrame, created_at: Column) -> DataFrame:
    return attributed.select(
        "request_id", "country", "field", "structurer", "value", F.col("raw_confidence").cast("decimal(10,6)").alias("raw_confidence"), F.col("confidence").cast("decimal(3,2)").alias("calibrated_confidence"), "latency_ms", F.when(F.col("was_selected"), "Y").otherwise("N").alias("was_selected"), created_at.alias("created_at")
    )


def compliance_rows(results: DataFrame, routed_at: Column) -> DataFrame:
    return results.select(
        F.xxhash64("idem_key").alias("result_id"), "correlation_id", F.col("country_hint").alias("country"), "decision", "would_decision", "primary_reason", F.to_json("reasons").alias("reasons_json"), "urgency", F.lit("PENDING").alias("status"), routed_at.alias("routed_at")
    )


def audit_rows(results: DataFrame, at: Column) -> DataFrame:
    return results.select("correlation_id", F.lit("ENRICHED").alias("event"), "source_channel", "outcome", F.to_json(F.struct("overall_confidence", "exception_reason", "decision")).alias("details"), at.alias("at"))


def key_rows(results: DataFrame, at: Column) -> DataFrame:
    return results.select("idem_key", "source_channel", F.col("correlation_id").alias("source_ref"), at.alias("processed_at"), F.xxhash64("idem_key").alias("result_ref"))


def document() -> Column:
    """The JSON answer for callers: fields, sources, consensus, reasons, recommendation."""
    return F.to_json(F.struct("correlation_id", "outcome", "overall_confidence", F.transform_values("fields", lambda k, v: v).alias("fields"), F.struct("agreements", "disagreements", "overall_consensus", "flagged_fields").alias("consensus"), F.map_keys("weights").alias("sources"), "review_reasons", "recommendation"))


def dispatch() -> Column:
    """The JSON message that asks compliance for a verdict."""
    return F.to_json(F.struct("correlation_id", F.col("country_hint").alias("country"), "primary_reason", "reasons", "urgency", F.struct(field_value("CTRY").alias("CTRY"), field_value("TWN_NM").alias("TWN_NM")).alias("address")))


def messages(results: DataFrame) -> DataFrame:
    """Key and value for an output topic."""
    return results.select(F.col("correlation_id").alias("key"), document().alias("value"))


def dispatches(results: DataFrame) -> DataFrame:
    """Key and value of the messages for compliance: requests that are routed."""
    # a filter on the decision would be pushed below all that it is made of, and make all of that again; one on an exploded row stays here
    each = results.select(F.explode(F.array(F.struct("decision", F.col("correlation_id").alias("key"), dispatch().alias("value")))).alias("m"))
    return each.where("m.decision <> 'BYPASS'").select("m.key", "m.value")


def published(messages: DataFrame, path: str) -> DataFrame:
    """Messages written to the file twin of a topic, and read back."""
    messages.write.mode("overwrite").json(path)
    return messages.sparkSession.read.schema("key string, value string").json(path)


def publish(messages: DataFrame, servers: str, topic: str) -> None:
    """Messages to a topic (needs the connector on the class path)."""
    messages.write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()


def dead_letters(rejected: DataFrame, attempt: Column | int = 1, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows to try again, and rows that are given up: malformed ones and those not ``retryable`` at once, others after ``most`` attempts."""
    tried = attempt if isinstance(attempt, Column) else F.lit(attempt)
    df = rejected.withColumn("attempt", tried)
    final = (F.col("reject_reason").isin("MALFORMED", "BLANK_ADDRESS", "TOO_LONG")) | (F.col("attempt") >= most)
    if "retryable" in df.columns:
        final = final | ~F.col("retryable")
    return df.where(~final).withColumn("attempt", F.col("attempt") + 1), df.where(final)


def write(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_days(df: DataFrame, path: str, by: str) -> None:
    """Parquet by day of ``by``, one task a day's hash: the days that ``df`` has replace what the table had of them, other days stay."""
    out = df.withColumn("day", F.to_date(by))
    out.repartition("day", F.pmod(F.xxhash64(*df.columns), F.lit(FILES_A_DAY))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
