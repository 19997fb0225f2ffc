"""Candidate values from parsers: simple rules, labelled tokens and model responses.

A structurer is a function from requests to candidate rows
``request_id, structurer, field, pos, value, raw_confidence``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import first_match, is_blank, jtrim, replace_all, rewrite, split_parts
from wayfold.operators.lookup import lookup
from wayfold.plans.config import FIELDS, GULF_REWRITES, PARSER_FIELDS, PARSER_LABELS, RESPONSE_ALIASES

Structurer = Callable[[DataFrame], DataFrame]
CANDIDATE = ("request_id", "structurer", "field", "pos", "value", "raw_confidence")


def _long(requests: DataFrame, name: str, found: list[tuple[str, Column, float]]) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("pos"), v.alias("value"), F.lit(c).alias("raw_confidence")) for k, (f, v, c) in enumerate(found)))
    rows = requests.select("request_id", F.lit(name).alias("structurer"), F.explode(F.filter(entries, lambda e: ~is_blank(e["value"]))).alias("e"))
    return rows.select("request_id", "structurer", "e.*").select(*CANDIDATE)


def comma_parts(requests: DataFrame) -> DataFrame:
    """Hint as country, first part as town, second as street."""
    parts = split_parts(F.col("raw"))
    return _long(requests, "stub", [("CTRY", F.col("country_hint"), 0.95), ("TWN_NM", F.get(parts, F.lit(0)), 0.85), ("STRT_NM", F.get(parts, F.lit(1)), 0.80)])


def by_rules(requests: DataFrame) -> DataFrame:
    """Patterns of a few countries: postcodes, blocks and units, floors, house numbers, boxes."""
    raw, hint = F.col("raw"), F.col("country_hint")
    postcode = (
        F.when(hint == "GB", first_match(raw, r"(?i)\b([A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})\b"))
        .when(hint.isin("SG", "CN"), first_match(raw, r"\b(\d{6})\b"))
        .when(hint.isin("US", "DE"), first_match(raw, r"\b(\d{5}(?:-\d{4})?)\b"))
        .when(hint == "CH", first_match(raw, r"\b(\d{4})\b"))
    )
    number = (
        F.when(hint == "SG", F.coalesce(first_match(raw, r"(?i)\bBlo?c?k\.?\s+(\d+[A-Z]?)\b"), first_match(raw, r"(#\d+-\d+)")))
        .when(hint == "DE", first_match(raw, r"(?i)(?:stra(?:ß|ss)e|str\.|weg|platz|allee)\s+(\d+\s?[a-z]?)\b"))
        .otherwise(first_match(raw, r"^\s*(\d+[A-Za-z]?)\b"))
    )
    building = F.when(hint == "HK", first_match(raw, r"(?i)\b((?:\d+|[A-Z])/F\.?(?:,? (?:Unit|Room|Flat) [\w-]+)?)"))
    box = first_match(raw, r"(?i)\b(P\.?\s?O\.?\s?Box\s+\d+)\b")
    return _long(requests, "rules", [("CTRY", hint, 0.70), ("PST_CD", postcode, 0.85), ("BLDG_NB", number, 0.75), ("BLDG_NM", building, 0.70), ("ADR_LINE", box, 0.80)])


def gulf_text(raw: Column) -> Column:
    """Ordered rewrites of abbreviations in addresses of the Emirates."""
    return rewrite(raw, GULF_REWRITES)


def from_labels(tokens: DataFrame, requests: DataFrame, name: str = "libpostal", confidence: float = 0.85, hint_confidence: float = 0.70) -> DataFrame:
    """Labelled parser tokens (``request_id, tokens array<struct<value,label>>``): the first value of a field counts; the hint stands in for a missing country."""
    each = tokens.select("request_id", F.posexplode("tokens").alias("pos", "t"))
    each = each.select("request_id", lookup(PARSER_LABELS, F.col("t.label")).alias("field"), "pos", jtrim(F.col("t.value")).alias("value")).where("field is not null and value <> ''")
    first = each.groupBy("request_id", "field").agg(F.min(F.struct("pos", "value")).alias("one")).select("request_id", "field", "one.*").withColumn("raw_confidence", F.lit(confidence))
    countries = first.where("field = 'CTRY'").select("request_id")
    hinted = requests.where("country_hint <> ''").join(countries, "request_id", "left_anti").select("request_id", F.lit("CTRY").alias("field"), F.lit(-1).alias("pos"), F.col("country_hint").alias("value"), F.lit(hint_confidence).alias("raw_confidence"))
    return first.unionByName(hinted).withColumn("structurer", F.lit(name)).select(*CANDIDATE)


def allowed(candidates: DataFrame, fields: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Only the fields that a structurer may fill; structurers that are not listed may fill all."""
    fields = {"libpostal": PARSER_FIELDS} if fields is None else fields
    keep = F.lit(True)
    for name, own in fields.items():
        keep = keep & ((F.col("structurer") != name) | F.col("field").isin(*own))
    return candidates.where(keep & ~is_blank(F.col("value")))


def envelope(responses: DataFrame, body: str = "body") -> DataFrame:
    """Completion envelopes: content (else the reasoning text), finish reason and token counts."""
    schema = "choices array<struct<message:struct<content:string,reasoning_content:string>,finish_reason:string>>, usage struct<prompt_tokens:long,completion_tokens:long>"
    parsed = responses.withColumn("_b", F.from_json(body, schema))
    one = F.get("_b.choices", F.lit(0))
    return parsed.withColumns(
        {
            "content": F.coalesce(F.nullif(one["message"]["content"], F.lit("")), one["message"]["reasoning_content"], F.lit("")),
            "finish_reason": F.coalesce(one["finish_reason"], F.lit("stop")),
            "input_tokens": F.coalesce("_b.usage.prompt_tokens", F.lit(0)),
            "output_tokens": F.coalesce("_b.usage.completion_tokens", F.lit(0)),
        }
    ).drop("_b")


def from_responses(responses: DataFrame, name: str, fields: tuple[str, ...] = FIELDS, content: str = "content", confidence: float = 0.85) -> DataFrame:
    """Fields of a model's JSON answer: fenced or bare, wrapped or flat, objects or strings; bad JSON gives none."""
    bare = jtrim(F.regexp_replace(F.regexp_replace(jtrim(F.col(content)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    root = F.from_json(bare, "map<string,string>")
    df = responses.withColumn("_root", root)
    inner = [F.from_json(F.when(F.try_element_at("_root", F.lit(k)).startswith("{"), F.try_element_at("_root", F.lit(k))), "map<string,string>") for k in ("fields", "address")]
    each = df.select("request_id", F.posexplode(F.map_entries(F.coalesce(*inner, "_root"))).alias("pos", "e"))
    each = each.select("request_id", lookup(RESPONSE_ALIASES, F.col("e.key")).alias("field"), "pos", F.col("e.value").alias("said")).where(F.col("field").isin(*fields))
    shaped = F.col("said").startswith("{")
    body = F.from_json("said", "value string, confidence double")
    each = each.withColumns({"value": F.when(shaped, body["value"]).otherwise(F.col("said")), "raw_confidence": F.coalesce(F.when(shaped, body["confidence"]), F.lit(confidence))}).where("value <> ''")
    first = each.groupBy("request_id", "field").agg(F.min(F.struct("pos", "value", "raw_confidence")).alias("one")).select("request_id", F.lit(name).alias("structurer"), "field", "one.*")
    return first.where(~is_blank(F.col("value"))).select(*CANDIDATE)


def from_wire(responses: DataFrame, name: str, fields: tuple[str, ...] = FIELDS, body: str = "body") -> DataFrame:
    """Answers in the wire form of structurers (a JSON object of fields with alternatives): candidates with ``alternatives`` and ``version``.

    Fields that the structurer may not fill, and answers that do not parse, give none.
    """
    answer = "struct<value:string,confidence:double,alternatives:array<struct<value:string,confidence:double>>>"
    parsed = responses.select("request_id", F.from_json(body, f"fields map<string,{answer}>, structurerVersion string").alias("_b"))
    each = parsed.select("request_id", F.col("_b.structurerVersion").alias("version"), F.posexplode("_b.fields").alias("pos", "field", "said")).where(F.col("field").isin(*fields))
    rows = each.select("request_id", F.lit(name).alias("structurer"), "field", "pos", F.col("said.value").alias("value"), F.coalesce("said.confidence", F.lit(0.0)).alias("raw_confidence"), F.col("said.alternatives").alias("alternatives"), "version")
    return rows.where(~is_blank(F.col("value")))


def prompts(requests: DataFrame, template: str, supplements: DataFrame) -> DataFrame:
    """Prompt text of each request: the template, its country's supplement, the three values."""
    joined = requests.join(supplements.withColumnRenamed("country", "_country"), F.col("country_hint") == F.col("_country"), "left")
    whole = F.concat(F.lit(template), F.when(F.col("supplement").isNotNull(), F.concat(F.lit("\n"), F.col("supplement"))).otherwise(""))
    filled = replace_all(whole, {"raw": F.col("raw"), "countryHint": F.col("country_hint"), "locale": F.col("locale")})
    return joined.select("request_id", filled.alias("prompt"))


def union_all(*candidates: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Candidates of all structurers with ``cascade_pos``, their place in the order."""
    first, *rest = candidates
    for c in rest:
        first = first.unionByName(c)
    return first.withColumn("cascade_pos", F.coalesce(lookup({s: k for k, s in enumerate(order)}, F.col("structurer")), F.lit(len(order))))
