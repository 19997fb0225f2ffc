"""Results by key: a Parquet table in buckets of the key, of which a batch reads only its own.

A folder ``bucket=B/span=F-L`` holds what the batches F to L wrote for the keys of
bucket B, sorted by key. Writing a batch replaces the folders of that batch
alone. ``compact`` merges a bucket's many spans into one; the merged folder's
span covers the old ones, and readers pass over a span that another covers, so
a merge that stops halfway neither loses nor repeats a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
#: Spans of a bucket that are merged once there are so many.
FANOUT = 16
#: Keys that are handed to the scan as a filter; more are joined.
LISTED = 1000
SCHEMA = "result_id long, idem_key string, correlation_id string, source_channel string, country string, fields_json string, trace_json string, overall_confidence decimal(3,2), requires_review string, outcome string, created_at timestamp, batch long"
KEYS = ("idem_key", "source_channel", "source_ref", "processed_at", "result_ref")


def bucket(key: str = "idem_key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Span:
    bucket: int
    first: int
    last: int
    path: str

    def covers(self, other: Span) -> bool:
        return self != other and self.bucket == other.bucket and self.first <= other.first and self.last >= other.last


def _files(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _files(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _files(spark, path)
    return fs.exists(p)


def spans(spark: SparkSession, path: str, buckets: list[int] | None = None) -> list[Span]:
    """The spans of some buckets, or of all; only their folders are listed."""
    chosen = "*" if buckets is None else "{" + ",".join(map(str, buckets)) + "}"
    if buckets is not None and not buckets:
        return []
    p, fs = _files(spark, f"{path}/bucket={chosen}/span=*")
    found = []
    for s in fs.globStatus(p) or []:
        first, last = s.getPath().getName().removeprefix("span=").split("-")
        found.append(Span(int(s.getPath().getParent().getName().removeprefix("bucket=")), int(first), int(last), s.getPath().toString()))
    return found


def visible(found: list[Span]) -> list[Span]:
    """Spans that no other covers."""
    by: dict[int, list[Span]] = {}
    for s in found:
        by.setdefault(s.bucket, []).append(s)
    return [s for own in by.values() for s in own if not any(o.covers(s) for o in own)]


def read(spark: SparkSession, path: str, buckets: list[int] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Stored rows of some buckets, or of all; up to ``LISTED`` keys become a filter of the scan."""
    shown = visible(spans(spark, path, buckets))
    if not shown:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(*(s.path for s in shown))
    return rows if keys is None or len(keys) > LISTED else rows.where(F.col("idem_key").isin(keys))


def lookup(requests: DataFrame, path: str) -> DataFrame:
    """Stored rows of the keys of ``requests``, a micro-batch: only their buckets are read."""
    spark = requests.sparkSession
    rows = requests.select("idem_key").distinct().select("idem_key", bucket().alias("bucket")).limit(LISTED + 1).collect()
    if len(rows) > LISTED:  # a large batch: at most BUCKETS numbers, and a join instead of a list
        buckets = [r.bucket for r in requests.select(bucket().alias("bucket")).distinct().collect()]
        return read(spark, path, buckets).join(requests.select("idem_key").distinct(), "idem_key", "left_semi")
    return read(spark, path, sorted({r.bucket for r in rows}), [r.idem_key for r in rows])


def write(rows: DataFrame, path: str, batch: int) -> None:
    """The rows of a batch into its own spans, in place of what an earlier try of the batch put there."""
    named = rows.withColumns({"batch": F.lit(batch).cast("long"), "bucket": bucket(), "span": F.lit(f"{batch}-{batch}")})
    _put(named, path)


def _put(rows: DataFrame, path: str) -> None:
    sorted_ = rows.repartition("bucket").sortWithinPartitions("bucket", "idem_key")
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "span").parquet(path)


def compact(spark: SparkSession, path: str, before: int, buckets: list[int] | None = None, fanout: int = FANOUT) -> int:
    """Merge the spans of buckets that have ``fanout`` or more; returns how many buckets were merged.

    Only batches ``before`` one, which can no longer be replayed, are merged.
    """
    found = [s for s in spans(spark, path, buckets) if s.last < before]
    by: dict[int, list[Span]] = {}
    for s in visible(found):
        by.setdefault(s.bucket, []).append(s)
    merged = {b: Span(b, min(s.first for s in own), max(s.last for s in own), "") for b, own in by.items() if len(own) >= fanout}
    if merged:
        rows = spark.read.schema(SCHEMA).parquet(*(s.path for b in merged for s in by[b]))
        # a merged folder's name follows from its rows' bucket
        label = F.create_map(*(x for b, s in merged.items() for x in (F.lit(b), F.lit(f"{s.first}-{s.last}"))))
        _put(rows.withColumn("bucket", bucket()).withColumn("span", label[F.col("bucket")]), path)
    for s in found:
        if s.bucket in merged and merged[s.bucket].covers(s) or any(o.covers(s) for o in by.get(s.bucket, [])):
            remove(spark, s.path)
    return len(merged)


def keys(rows: DataFrame) -> DataFrame:
    """The key table: who claimed each key, when, and with which result."""
    return rows.select("idem_key", "source_channel", F.col("correlation_id").alias("source_ref"), F.col("created_at").alias("processed_at"), F.col("result_id").alias("result_ref"))


def live(rows: DataFrame, as_of: Column | None, days: int | None) -> DataFrame:
    """Rows whose key is still held: all, or those within the retention."""
    return rows if days is None else rows.where(F.col("created_at") >= as_of - F.expr(f"interval {days} days"))
