"""Backfill by key ranges: a source that plans its own ranges, and a run that can stop and go on.

``LegacySource`` reads a table over Python's database interface: the driver
asks for the least and largest key, cuts what lies between into ranges, and each task
reads one range with its own connection. Comparisons of the key with numbers
are pushed down, so ranges outside them are not planned.

``run`` works through the ranges that its table of finished ranges lacks, some at
a time. Each range's results replace that range's folder before the
range is marked, so a range that was cut off is done again and none twice.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from wayfold.sources.requests import LEGACY

WIDTH = 10_000
WAVE = 64
FETCH = 10_000
FINISHED = "low long, high long, n_rows long"


def connect(database: str):
    """A connection that cannot write; another database's takes its place through ``LegacySource.connect``."""
    return sqlite3.connect(f"file:{database}?mode=ro", uri=True)


@dataclass
class Range(InputPartition):
    low: int
    high: int


class LegacySource(DataSource):
    """``spark.read.format("legacy_ranges")`` with options database, table, key, width, columns, and ranges (a list as JSON) to read just these."""

    connect = staticmethod(connect)

    @classmethod
    def name(cls) -> str:
        return "legacy_ranges"

    def schema(self) -> str:
        return self.options.get("columns", LEGACY)

    def reader(self, schema) -> DataSourceReader:
        return LegacyReader(dict(self.options), schema, self.connect)


class LegacyReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema, connect: Callable):
        self.options, self.names, self.connect = options, schema.fieldNames(), connect
        self.table, self.key = options["table"], options.get("key", "party_id")
        self.low: int | None = None
        self.high: int | None = None
        if not all(x.replace("_", "").isalnum() for x in (self.table, self.key, *self.names)):
            raise ValueError("names of tables and columns are letters, digits and underscores")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take bounds of the key; all else stays with Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            values = value if isinstance(f, In) else (value,)
            if f.attribute != (self.key,) or not all(isinstance(v, int) for v in values) or not values:
                yield f
            elif isinstance(f, EqualTo):
                self._bound(value, value)
            elif isinstance(f, In):
                self._bound(min(values), max(values))
                yield f
            elif isinstance(f, GreaterThan):
                self._bound(value + 1, None)
            elif isinstance(f, GreaterThanOrEqual):
                self._bound(value, None)
            elif isinstance(f, LessThan):
                self._bound(None, value - 1)
            elif isinstance(f, LessThanOrEqual):
                self._bound(None, value)
            else:
                yield f

    def _bound(self, low: int | None, high: int | None) -> None:
        self.low = low if self.low is None or (low is not None and low > self.low) else self.low
        self.high = high if self.high is None or (high is not None and high < self.high) else self.high

    def partitions(self) -> list[Range]:
        if "ranges" in self.options:
            planned = [Range(a, b) for a, b in json.loads(self.options["ranges"])]
        else:
            db = self.connect(self.options["database"])
            least, most = db.execute(f"select min({self.key}), max({self.key}) from {self.table}").fetchone()  # noqa: S608  checked names
            db.close()
            planned = [Range(a, b) for a, b in ranges(least, most, int(self.options.get("width", WIDTH)))]
        low, high = self.low, self.high
        cut = [Range(r.low if low is None else max(low, r.low), r.high if high is None else min(high, r.high)) for r in planned]
        return [r for r in cut if r.low <= r.high] or [Range(0, -1)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.low > partition.high:
            return
        db = self.connect(self.options["database"])
        try:
            rows = db.execute(f"select {', '.join(self.names)} from {self.table} where {self.key} between ? and ? order by {self.key}", (partition.low, partition.high))  # noqa: S608  checked names
            while block := rows.fetchmany(FETCH):
                yield from block
        finally:
            db.close()


def ranges(least: int | None, most: int | None, width: int) -> list[tuple[int, int]]:
    """Ranges of ``width`` keys from the multiple of it at or below ``least``: the same whatever was finished before."""
    if least is None or most is None:
        return []
    return [(low, low + width - 1) for low in range(least // width * width, most + 1, width)]


def finished(spark: SparkSession, store: str) -> list[tuple[int, int]]:
    """Ranges that are done: some bytes each, as many as the key space has."""
    from wayfold.streaming.store import exists

    path = f"{store}/finished"
    rows = spark.read.schema(FINISHED).parquet(path).select("low", "high").distinct().collect() if exists(spark, path) else []
    return [(r.low, r.high) for r in rows]


def run(spark: SparkSession, read: Callable[[list[tuple[int, int]]], DataFrame], key: str, planned: list[tuple[int, int]], store: str, work: Callable[[DataFrame], DataFrame], wave: int = WAVE, stop_after: int | None = None) -> int:
    """Work through the ranges left, ``wave`` at a time; returns how many were done.

    ``read`` gives the rows of some ranges, ``work`` turns rows into results that
    still have ``key``. ``stop_after`` ends the run after so many waves.
    """
    done = set(finished(spark, store))
    left = [r for r in planned if r not in done]
    width = planned[0][1] - planned[0][0] + 1 if planned else 1
    count = 0
    for k in range(0, len(left), wave):
        if stop_after is not None and k // wave >= stop_after:
            break
        own = left[k : k + wave]
        # a range is one task's, so it is one file, and the driver hears of as many files as ranges
        rows = work(read(own)).withColumn("range", (F.floor(F.col(key) / width) * width).cast("long")).repartition("range").persist(StorageLevel.DISK_ONLY)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(f"{store}/results")
        counts = rows.groupBy(F.col("range").alias("low")).agg(F.count("*").alias("n_rows"))
        marked = spark.createDataFrame(own, "low long, high long").join(counts, "low", "left").select("low", "high", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        marked.coalesce(1).write.mode("append").parquet(f"{store}/finished")
        rows.unpersist()
        count += len(own)
    return count


def results(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/results")


def between(rows: DataFrame, key: str) -> Callable[[list[tuple[int, int]]], DataFrame]:
    """Ranges of a table that Spark reads itself; neighbouring ranges become one comparison."""

    def read(own: list[tuple[int, int]]) -> DataFrame:
        joined: list[list[int]] = []
        for low, high in sorted(own):
            if joined and joined[-1][1] + 1 == low:
                joined[-1][1] = high
            else:
                joined.append([low, high])
        chosen = F.lit(False)
        for low, high in joined:
            chosen = chosen | F.col(key).between(low, high)
        return rows.where(chosen)

    return read


def legacy(spark: SparkSession, **options: str) -> Callable[[list[tuple[int, int]]], DataFrame]:
    """Ranges of a database table, one task each."""
    spark.dataSource.register(LegacySource)

    def read(own: list[tuple[int, int]]) -> DataFrame:
        return spark.read.format("legacy_ranges").options(ranges=json.dumps(own), **options).load()

    return read
