"""Payment messages: postal addresses of the parties of XML, event and line messages, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import is_blank, jtrim
from wayfold.operators.merge import field_value

TAGS = {"CTRY": "Ctry", "TWN_NM": "TwnNm", "PST_CD": "PstCd", "CTRY_SUB_DVSN": "CtrySubDvsn", "STRT_NM": "StrtNm", "BLDG_NB": "BldgNb", "BLDG_NM": "BldgNm"}
POSTAL = "struct<" + ",".join(f"{t}:string" for t in TAGS.values()) + ",AdrLine:array<string>>"
ROLES = ("Dbtr", "Cdtr", "DbtrAgt", "CdtrAgt")


def _schema(roles: tuple[str, ...]) -> str:
    party = ",".join(f"{r}:struct<Nm:string,PstlAdr:{POSTAL}>" for r in roles)
    return f"FIToFICstmrCdtTrf struct<CdtTrfTxInf:array<struct<{party}>>>"


def parties(messages: DataFrame, xml: str = "xml", roles: tuple[str, ...] = ROLES[:2]) -> DataFrame:
    """One row an address: ``message_id, tx, role, correlation_id, PstlAdr``; XML that does not parse gives none."""
    body = messages.select("message_id", F.from_xml(F.col(xml), _schema(roles), {"mode": "PERMISSIVE"}).alias("b"))
    tx = body.select("message_id", F.posexplode("b.FIToFICstmrCdtTrf.CdtTrfTxInf").alias("tx", "t"))
    both = F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"t.{r}.PstlAdr").alias("PstlAdr")) for r in roles))
    rows = tx.select("message_id", "tx", F.explode(both).alias("p")).select("message_id", "tx", "p.*").where("PstlAdr is not null")
    return rows.withColumn("correlation_id", F.concat_ws("/", "message_id", "tx", "role"))


def event_parties(events: DataFrame, value: str = "value") -> DataFrame:
    """Payment events in an envelope with the XML as data: all four roles."""
    body = F.from_json(F.col(value).cast("string"), "id string, type string, data string")
    rows = events.select(body.alias("b")).select(F.col("b.id").alias("message_id"), F.col("b.data").alias("xml"))
    return parties(rows, "xml", ROLES)


def is_structured(address: str = "PstlAdr") -> Column:
    """Country and town are there already."""
    return ~is_blank(F.col(f"{address}.Ctry")) & ~is_blank(F.col(f"{address}.TwnNm"))


def to_requests(rows: DataFrame) -> DataFrame:
    """Free lines of addresses that are not structured yet."""
    raw = F.array_join(F.col("PstlAdr.AdrLine"), ", ")
    out = rows.where(~is_structured()).select("correlation_id", raw.alias("raw"), F.coalesce("PstlAdr.Ctry", F.lit("")).alias("country_hint"))
    return out.where(~is_blank(F.col("raw")))


def to_postal(fields: str = "fields") -> Column:
    """A merged address as a postal block."""
    own = [field_value(f, fields).alias(t) for f, t in TAGS.items()]
    line = field_value("ADR_LINE", fields)
    return F.struct(*own, F.when(line.isNotNull(), F.array(line)).alias("AdrLine"))


def to_hybrid(fields: str = "fields") -> Column:
    """Structured fields, with the free line only where no street was found."""
    own = [field_value(f, fields).alias(t) for f, t in TAGS.items()]
    return F.struct(*own, F.when(field_value("STRT_NM", fields).isNull() & field_value("ADR_LINE", fields).isNotNull(), F.array(field_value("ADR_LINE", fields))).alias("AdrLine"))


def from_postal(address: str = "PstlAdr") -> Column:
    """A postal block as fields of confidence 1; blank elements are left out."""
    entry = [F.struct(F.lit(f).alias("key"), F.struct(F.col(f"{address}.{t}").alias("value"), F.lit(1.0).alias("confidence"), F.lit("SINGLE_SOURCE").alias("merge_strategy")).alias("value")) for f, t in TAGS.items()]
    line = F.struct(F.lit("ADR_LINE").alias("key"), F.struct(F.array_join(F.col(f"{address}.AdrLine"), ", ").alias("value"), F.lit(1.0).alias("confidence"), F.lit("SINGLE_SOURCE").alias("merge_strategy")).alias("value"))
    return F.map_from_entries(F.filter(F.array(*entry, line), lambda e: ~is_blank(e["value"]["value"])))


def write_back(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Merged fields over partly filled blocks, for successes; others keep their block. ``xml`` is the block's text."""
    won = results.where(F.col("outcome").isin("SUCCESS", "PERSISTED_DUPLICATE")).select("correlation_id", to_postal().alias("_new"))
    joined = rows.join(won, "correlation_id", "left")
    merged = F.struct(*(F.coalesce(F.col(f"_new.{t}"), F.col(f"PstlAdr.{t}")).alias(t) for t in TAGS.values()), F.when(F.col("_new").isNull(), F.col("PstlAdr.AdrLine")).otherwise(F.col("_new.AdrLine")).alias("AdrLine"))
    out = joined.withColumn("PstlAdr", F.coalesce(F.when(F.col("_new").isNotNull(), merged), F.col("PstlAdr"))).drop("_new")
    return out.withColumn("xml", F.to_xml(F.col("PstlAdr"), {"rowTag": "PstlAdr"}))


def line_parties(messages: DataFrame) -> DataFrame:
    """Name and address lines of tags 50K and 59: the name is dropped, the rest joined. ``message_id`` is field 20."""
    lines = F.filter(F.transform(F.split("lines", r"\r?\n"), jtrim), lambda x: x != "")
    kept = F.filter(lines, lambda x: ~x.startswith("/"))
    rows = messages.where(F.col("tag").isin("50K", "59")).withColumn("_lines", kept)
    return rows.select(F.concat_ws("/", "message_id", "tag").alias("correlation_id"), F.array_join(F.slice("_lines", 2, 100), ", ").alias("raw")).where("raw <> ''")
