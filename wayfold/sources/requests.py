"""Requests from messages, batches, legacy tables, fixtures and plain columns.

All of them end in one shape, ``REQUEST``; rows that break a rule go to a
quarantine with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions.text import clean_hint, is_blank, join_lines, jtrim
from wayfold.plans.config import CHANNELS, MAX_BATCH, MAX_RAW

MESSAGE = "rawAddress string, countryHint string, locale string, _corrupt_record string"
BATCH = "batch_id string, items array<struct<rawAddress:string,countryHint:string,locale:string>>"
LEGACY = "party_id string, address_line_1 string, address_line_2 string, address_line_3 string, address_line_4 string, country_code string, postal_code string, last_updated timestamp, source_system string"
REQUEST = ("correlation_id", "source_channel", "raw", "country_hint", "locale", "arrival_ts")


def _shape(df: DataFrame, correlation: Column, channel: str, raw: Column, hint: Column, locale: Column, at: Column) -> DataFrame:
    if channel not in CHANNELS:
        raise ValueError(f"unknown channel {channel}")
    said = [F.coalesce(c, F.lit("")) for c in (raw, hint, locale)]
    return df.withColumns(dict(zip(REQUEST, (correlation, F.lit(channel), *said, at), strict=True)))


def parse_messages(messages: DataFrame, channel: str = "KAFKA", value: str = "value") -> DataFrame:
    """JSON payloads of either broker; ``_corrupt_record`` is set for malformed ones.

    The correlation id is the header, else the key, else a hash of the place in
    the stream, so a replay gives the same id. Works on streams and tables.
    """
    body = F.from_json(F.col(value).cast("string"), MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = messages.withColumn("_body", body)
    none = F.lit(None).cast("string")
    named = {c: (F.col(c).cast("string") if c in messages.columns else none) for c in ("correlation_header", "key", "topic", "partition", "offset")}
    place = F.sha2(F.concat_ws("/", *(named[c] for c in ("topic", "partition", "offset")), F.col(value).cast("string")), 256)
    correlation = F.coalesce(*(F.when(~is_blank(named[c]), named[c]) for c in ("correlation_header", "key")), place)
    at = F.col("timestamp") if "timestamp" in messages.columns else F.lit(None).cast("timestamp")
    out = _shape(df, correlation, channel, F.col("_body.rawAddress"), F.col("_body.countryHint"), F.col("_body.locale"), at)
    return out.withColumn("_corrupt_record", F.when(F.col("_body").isNull() | F.col("_body._corrupt_record").isNotNull(), F.col(value).cast("string"))).drop("_body")


def expand_batches(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One request an item with id ``batch/i``; batches of more than the limit are refused whole."""
    fits = F.size("items") <= MAX_BATCH
    rows = batches.where(fits).select("batch_id", F.posexplode("items").alias("i", "item"))
    out = _shape(rows, F.concat_ws("/", "batch_id", F.col("i").cast("string")), "HTTP", F.col("item.rawAddress"), F.col("item.countryHint"), F.col("item.locale"), F.lit(None).cast("timestamp"))
    return out.select(*REQUEST), batches.where(~fits).select("batch_id", F.size("items").alias("n_items"))


def from_legacy(addresses: DataFrame) -> DataFrame:
    """Backfill requests: four lines joined, blank rows left out, hints of two letters only."""
    raw = join_lines(*(F.col(f"address_line_{k}") for k in range(1, 5)))
    code = jtrim(F.coalesce("country_code", F.lit("")))
    hint = F.when(F.length(code) == 2, code).otherwise("")
    party = F.when(is_blank(F.col("party_id")), "unknown").otherwise(F.col("party_id"))
    out = _shape(addresses, F.concat(F.lit("backfill-"), party), "BACKFILL", raw, hint, F.lit(""), F.col("last_updated"))
    return out.where("raw <> ''").select(*REQUEST)


def legacy(spark: SparkSession, path: str) -> DataFrame:
    """The legacy table; a missing country reads as empty."""
    return spark.read.schema(LEGACY).parquet(path).withColumn("country_code", F.coalesce("country_code", F.lit("")))


def legacy_jdbc(spark: SparkSession, url: str, table: str, low: int, high: int, partitions: int = 32, fetch: int = 10_000) -> DataFrame:
    """The legacy table over JDBC, read in ranges of the party number (needs the driver on the class path)."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="PARTY_ID", lowerBound=low, upperBound=high, numPartitions=partitions, fetchsize=fetch).load()


def by_party(addresses: DataFrame, party_id: str) -> DataFrame:
    return addresses.where(F.col("party_id") == party_id)


def row_count(addresses: DataFrame) -> DataFrame:
    """How many rows the table has, counted."""
    return addresses.agg(F.count("*").alias("n"))


def party_range(parties: DataFrame, addresses: DataFrame, low, high) -> DataFrame:
    """Parties of a key range with their primary address."""
    return parties.where(F.col("party_id").between(low, high)).join(addresses.where("is_primary = 'Y'"), "party_id")


def validate(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean requests, and rejected rows with ``reject_reason``."""
    corrupt = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in requests.columns else F.lit(False)
    reason = (
        F.when(corrupt, "MALFORMED")
        .when(is_blank(F.col("raw")), "BLANK_ADDRESS")
        .when(F.length("raw") > MAX_RAW, "TOO_LONG")
        .when(is_blank(F.col("correlation_id")), "NO_CORRELATION_ID")
        .when(~F.col("source_channel").isin(*CHANNELS), "UNKNOWN_CHANNEL")
    )
    df = requests.withColumn("reject_reason", reason)
    hint = clean_hint(F.col("country_hint"))
    good = df.where("reject_reason is null").withColumns({"hint_dropped": (hint == "") & (F.col("country_hint") != ""), "country_hint": hint})
    return good.drop("reject_reason", "_corrupt_record"), df.where("reject_reason is not null")


def union_all(*channels: DataFrame) -> DataFrame:
    """All channels in one shape."""
    first, *rest = (c.select(*REQUEST) for c in channels)
    for c in rest:
        first = first.unionByName(c)
    return first


# Fixtures


def golden(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fixtures and their expected fields in long form; an expectation is an object or a bare string.

    A file holds a fixture, or with ``lines`` one a line, any number of them.
    """
    schema = "fixture_id string, country string, source string, raw string, country_hint string, locale string, expected_fields map<string,string>, validator string, validated_at string, notes string"
    df = spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    each = df.select("fixture_id", "country", F.explode("expected_fields").alias("field", "said"))
    body = F.from_json("said", "value string, required boolean")
    shaped = F.col("said").startswith("{")
    return df, each.select("fixture_id", "country", "field", F.when(shaped, body["value"]).otherwise(F.col("said")).alias("expected"), F.when(shaped, body["required"]).alias("required"))


def sampled(fixtures: DataFrame) -> DataFrame:
    """The first fixture of each folder, by path; of fixtures in one file the one with the smallest id."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return fixtures.withColumn("_first", F.row_number().over(W.partitionBy(folder).orderBy("path", "fixture_id"))).where("_first = 1").drop("_first")


def adhoc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fixture_id string, country string, raw string, country_hint string, locale string").option("multiLine", True).json(path)


def external_fixtures(rows: DataFrame, iso: dict[str, str], cap: int = 15, least: int = 10) -> DataFrame:
    """Labelled addresses of another source as fixtures: known countries, long enough, at most ``cap`` a country.

    ``rows``: ``address, country_name, labels map<string,string>``; the cap is part of the feature.
    """
    from wayfold.operators.lookup import lookup
    from wayfold.plans.config import PARSER_LABELS

    code = lookup({k.lower(): v for k, v in iso.items()}, F.lower(jtrim(F.col("country_name"))))
    known = rows.withColumn("country", code).where(F.col("country").isNotNull() & (F.length("address") >= least))
    drawn = known.withColumn("_n", F.row_number().over(W.partitionBy("country").orderBy(F.sha2("address", 256), "address"))).where(F.col("_n") <= cap)
    fields = F.map_from_entries(F.filter(F.transform(F.map_entries("labels"), lambda e: F.struct(lookup(PARSER_LABELS, e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"].isNotNull()))
    return drawn.select(F.concat_ws("-", "country", F.lpad(F.col("_n").cast("string"), 3, "0")).alias("fixture_id"), "country", F.col("address").alias("raw"), fields.alias("expected_fields"))


def golden_bases(own: DataFrame, external: DataFrame, most: int = 5) -> DataFrame:
    """Own fixtures with at most ``most`` external ones a country; the limit is the feature."""
    drawn = external.withColumn("_n", F.row_number().over(W.partitionBy("country").orderBy("fixture_id"))).where(F.col("_n") <= most).drop("_n")
    return own.unionByName(drawn)
