"""Streams of requests: checkpointed, once a key, with timed retries, dead letters and live counts.

The body of a micro-batch is the batch plan. Results go to a table in buckets
of the key (``store``), of which a batch reads only its own buckets. A
key with a stored result is a duplicate, however late it comes, and is answered
from that result. Requests whose decision failed for a passing reason wait in
``retry`` until they are due; so do the repeats of such a request in its batch,
since there is no result yet to answer them with. ``ticks`` make a batch
where no message comes, so waiting requests are tried on time.

A replayed batch finds what its first run stored, keeps it, and replaces
its other outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wayfold.operators import dedup
from wayfold.operators.decide import duplicate_outcome, triage
from wayfold.sources import sinks
from wayfold.sources.requests import REQUEST, parse_messages, validate
from wayfold.streaming import store as results

RETRY = "correlation_id string, source_channel string, raw string, country_hint string, locale string, arrival_ts timestamp, attempt int, reject_reason string, due_at timestamp"
BATCH = 100
#: Seconds before a failed request is tried again.
DELAY = 1.0


def kafka(spark: SparkSession, servers: str, topic: str, most: int = BATCH) -> DataFrame:
    """Committed messages of a topic with its correlation header (needs the connector on the class path)."""
    df = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "includeHeaders": "true", "kafka.isolation.level": "read_committed", "maxOffsetsPerTrigger": most}).load()
    header = F.filter("headers", lambda h: h["key"] == "X-Correlation-Id")
    return df.withColumn("correlation_header", F.get(header, F.lit(0))["value"].cast("string"))


def files(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The file twin of the brokers: one JSON message a line."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path).withColumn("timestamp", F.current_timestamp())


def ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A clock as a stream of empty messages."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.lit(None).cast("string").alias("value"), "timestamp")


def with_ticks(messages: DataFrame, per_second: int = 1) -> DataFrame:
    """Messages and a clock: a batch comes at least ``per_second``, and its empty messages only look after what is due."""
    return messages.unionByName(ticks(messages.sparkSession, per_second), allowMissingColumns=True)


def waiting(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    """What the batch before left to be tried again."""
    path = f"{store}/retry/batch={batch_id - 1}"
    return spark.read.schema(RETRY).parquet(path) if results.exists(spark, path) else spark.createDataFrame([], RETRY)


def process(batch: DataFrame, batch_id: int, store: str, decide: Callable[[DataFrame], DataFrame], channel: str = "KAFKA", delay: float = 0.0, now: Column | None = None, days: int | None = None) -> None:
    """One micro-batch: parse, add what is due, refuse, claim, decide, store results, answer duplicates, and put off failures.

    ``decide`` may append ``error``; a request with one has no result. A failed
    request waits ``delay`` seconds; ``days`` ends a key's hold on its result.
    """
    spark = batch.sparkSession
    now = F.current_timestamp() if now is None else now
    columns = [*REQUEST, "attempt"]
    held = waiting(spark, store, batch_id).withColumn("_due", F.coalesce(F.col("due_at") <= now, F.lit(True))).persist()
    again = held.where("_due").select(*columns, F.lit(None).cast("string").alias("_corrupt_record"))
    parsed = parse_messages(batch.where("value is not null"), channel).select(*REQUEST, F.lit(1).alias("attempt"), "_corrupt_record").unionByName(again).persist()
    path = f"{store}/results"
    try:
        good, bad = validate(parsed)
        keyed = dedup.with_key(good.select(*columns)).withColumn("request_id", F.xxhash64("idem_key")).persist()
        stored = results.live(results.lookup(keyed, path), now, days).persist()
        first_run = stored.where(F.col("batch") == batch_id)
        # of a replayed batch, requests that have their result are neither decided again nor repeats
        keyed_open = keyed.join(first_run.select("idem_key", "correlation_id"), ["idem_key", "correlation_id"], "left_anti")
        fresh = dedup.claim(keyed_open, stored)
        decided = decide(fresh).persist()
        failing = "error" in decided.columns
        failed = F.col("error").isNotNull() if failing else F.lit(False)
        rejected = bad.select(*columns, "reject_reason", "_corrupt_record", F.lit(False).alias("retryable"))
        if failing:
            # a failure is that of all requests of its key in the batch, each with its own attempts
            lost = triage(decided.where(failed), "error").select("idem_key", F.col("error").alias("reject_reason"), "retryable")
            rejected = rejected.unionByName(keyed_open.join(lost, "idem_key").select(*columns, "reject_reason", F.lit(None).cast("string").alias("_corrupt_record"), "retryable"))
        retry, dead = sinks.dead_letters(rejected, F.col("attempt"))
        done = sinks.result_rows(decided.where(~failed), F.coalesce("arrival_ts", now)).persist()
        results.write(done.unionByName(first_run.drop("batch")), path, batch_id)
        dead.select(*columns, "reject_reason", "_corrupt_record").write.mode("overwrite").parquet(f"{store}/dead/batch={batch_id}")
        put_off = retry.select(*columns, "reject_reason", (now + F.make_dt_interval(secs=F.lit(delay))).alias("due_at")).unionByName(held.where("not _due").drop("_due"))
        put_off.write.mode("overwrite").parquet(f"{store}/retry/batch={batch_id}")
        answered(keyed_open, stored.drop("batch").unionByName(done), fresh).write.mode("overwrite").parquet(f"{store}/duplicates/batch={batch_id}")
        touched = sorted(r.bucket for r in done.select(results.bucket().alias("bucket")).distinct().collect())  # at most BUCKETS numbers
        for df in (done, decided, stored, keyed):
            df.unpersist()
        results.compact(spark, path, batch_id, touched)
        results.remove(spark, f"{store}/retry/batch={batch_id - 2}")  # a replay needs the batch before, no more
    finally:
        parsed.unpersist()
        held.unpersist()


def answered(requests: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Requests that repeat a key with a result, of an earlier batch or of their own, with the outcome of that result."""
    repeats = requests.join(fresh.select("idem_key", "correlation_id"), ["idem_key", "correlation_id"], "left_anti")
    found = dedup.resolve(repeats, stored, stored.select("idem_key", "result_id", "requires_review", "overall_confidence"))
    return found.select("correlation_id", "source_channel", "idem_key", "result_id", duplicate_outcome().alias("outcome"), F.coalesce("overall_confidence", F.lit(0)).cast("decimal(3,2)").alias("overall_confidence"), "is_duplicate")


def stored_results(spark: SparkSession, store: str) -> DataFrame:
    return results.read(spark, f"{store}/results")


def stored_keys(spark: SparkSession, store: str) -> DataFrame:
    return results.keys(stored_results(spark, store))


def start(source: DataFrame, store: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame], channel: str = "KAFKA", delay: float = DELAY, days: int | None = None) -> DataStreamWriter:
    """A writer whose query acknowledges messages once their batch is written."""
    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: process(df, n, store, decide, channel, delay, days=days))


def recent_only(requests: DataFrame, ts: str = "arrival_ts", days: int = 30) -> DataFrame:
    """A bounded pre-filter of repeated keys; the key table still decides."""
    return requests.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark(["idem_key"])


def live_metrics(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 minute", by: tuple[str, ...] = ("source_channel", "outcome")) -> DataFrame:
    """Counts and mean latency by window; a plain table works as well as a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("processed"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms")).select(F.col("w.start").alias("window_start"), *by, "processed", "avg_latency_ms")


def redeliver(messages: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Messages to deliver again, and those that have been tried ``most`` times."""
    return messages.where(F.col("attempt") < most), messages.where(F.col("attempt") >= most)
