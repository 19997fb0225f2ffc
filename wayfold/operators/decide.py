"""Outcome, review, compliance and format decisions as Column expressions over ``fields``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import is_blank
from wayfold.operators.lookup import constant_map, lookup
from wayfold.operators.merge import field_confidence, field_value
from wayfold.plans.config import COMPLIANCE, ERROR_STATUS, FIELDS, MANDATORY, NO_POSTCODE, POSTCODES, REASONS, RETRYABLE, REVIEW_RULES, REVIEW_THRESHOLD


def has_mandatory() -> Column:
    """CTRY and TWN_NM are both there."""
    parts = [F.coalesce(F.map_contains_key("fields", F.lit(f)), F.lit(False)) for f in MANDATORY]
    return parts[0] & parts[1]


def overall_confidence() -> Column:
    """The lesser of the mandatory fields' confidences; 0 if one is missing."""
    return F.when(has_mandatory(), F.least(*(field_confidence(f) for f in MANDATORY))).otherwise(0.0)


def outcome(threshold: Column | float = REVIEW_THRESHOLD) -> Column:
    """Before review rules: nothing structured, something missing, too little confidence, or success."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    none = F.col("fields").isNull() | (F.size("fields") == 0)
    return F.when(none, "UNSTRUCTURABLE").when(~has_mandatory() | (F.col("overall_confidence") < limit), "REQUIRES_REVIEW").otherwise("SUCCESS")


def exception_reason(threshold: Column | float = REVIEW_THRESHOLD) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    none = F.col("fields").isNull() | (F.size("fields") == 0)
    return F.when(none, "UNSTRUCTURABLE").when(~has_mandatory(), "MISSING_REQUIRED").when(F.col("overall_confidence") < limit, "LOW_CONFIDENCE")


def upgraded(reasons: str = "review_reasons", before: str = "outcome") -> Column:
    """A success with review reasons needs review."""
    return F.when((F.col(before) == "SUCCESS") & (F.size(reasons) > 0), "REQUIRES_REVIEW").otherwise(F.col(before))


def recommendation(reasons: str = "review_reasons") -> Column:
    return F.when(F.size(reasons) == 0, "AutoApproved").otherwise("ManualReview")


def is_success(of: str = "outcome") -> Column:
    return F.col(of).isin("SUCCESS", "PERSISTED_DUPLICATE")


def duplicate_outcome(flag: str = "requires_review") -> Column:
    """What a repeated request gets: the stored row's outcome, or a bare duplicate."""
    return F.when(F.col(flag).isNull(), "PERSISTED_DUPLICATE").when(F.col(flag) == "Y", "REQUIRES_REVIEW").otherwise("SUCCESS")


def triage(df: DataFrame, error: str = "error") -> DataFrame:
    """Append whether an error is worth a retry, and its HTTP status."""
    return df.withColumns({"retryable": F.col(error).isin(*RETRYABLE), "http_status": F.coalesce(lookup(ERROR_STATUS, F.col(error)), F.lit(500))})


# Review rules


def _number(value, default: float) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


def _names(value) -> list[str]:
    return [x.strip() for x in str(value or "").split(",") if x.strip()]


def _rule(rule: dict) -> Column | None:
    """Details if the rule fires, else null; a rule that is unknown or has no fields says nothing."""
    kind, params = rule["type"], rule.get("params", {})
    if kind == "LOW_CONFIDENCE":
        limit = _number(params.get("threshold"), 0.70)
        return F.when(F.col("overall_confidence") < limit, F.format_string("confidence=%.3f < threshold=%.3f", "overall_confidence", F.lit(limit)))
    if kind == "MISSING_FIELDS" and (names := _names(params.get("fields"))):
        there = F.map_keys(F.map_filter("fields", lambda k, v: v["value"] != ""))
        missing = F.array_sort(F.array_except(F.array(*map(F.lit, names)), F.coalesce(there, F.array().cast("array<string>"))))
        return F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    if kind == "CONSENSUS_DISAGREEMENT":
        return F.when(F.col("disagreements") >= int(_number(params.get("min-disagreements"), 2)), F.concat(F.lit("disagreements="), F.col("disagreements")))
    if kind == "SINGLE_SOURCE":
        least = int(_number(params.get("min-sources"), 2))
        return F.when(F.col("source_count").isNull(), "sourceCount=1 (no consensus)").when(F.col("source_count") < least, F.concat(F.lit("sourceCount="), F.col("source_count"), F.lit(f" < min={least}")))
    if kind == "HIGH_RISK_COUNTRY" and (names := _names(params.get("countries"))):
        return F.when(F.upper("country_hint").isin(*names), F.concat(F.lit("country="), F.col("country_hint")))
    if kind == "FIELD_CONFIDENCE_FLOOR" and (names := _names(params.get("fields"))):
        limit = _number(params.get("threshold"), 0.50)
        low = F.array_compact(F.array(*(F.when((field_value(f) != "") & (field_confidence(f) < limit), F.concat(F.lit(f + "="), F.format_string("%.3f", field_confidence(f)))) for f in sorted(names))))
        return F.when(F.size(low) > 0, F.concat(F.lit("below floor: "), F.array_join(low, ", ")))
    return None


def review_reasons(rules: tuple[dict, ...] = REVIEW_RULES) -> Column:
    """Reasons of all enabled rules that fire, in configured order."""
    said = []
    for rule in rules:
        details = _rule(rule) if rule.get("enabled", True) else None
        if details is not None:
            said.append(F.when(details.isNotNull(), F.struct(F.lit(rule["name"]).alias("rule"), F.lit(rule.get("description", "")).alias("description"), details.alias("details"))))
    if not said:
        return F.array().cast("array<struct<rule:string,description:string,details:string>>")
    return F.array_compact(F.array(*said))


# Compliance


def compliance_reasons(config: dict = COMPLIANCE) -> Column:
    """Reasons on four axes and two states, in their fixed order."""
    floors = [field_confidence(f).isNull() | (field_confidence(f) < x) for f, x in config["field_floors"].items()]
    low_field = F.lit(False)
    for f in floors:
        low_field = low_field | f
    structured = F.upper(F.coalesce(field_value("CTRY"), F.lit("")))
    country = F.when(structured != "", structured).otherwise(F.upper(F.coalesce("country_hint", F.lit(""))))
    watched = F.col(config["watched"]) if config.get("watched") else F.upper("raw").rlike("(?i)" + "|".join(f"(?:{p})" for p in config["patterns"])) if config["patterns"] else F.lit(False)
    fires = (
        (F.size("fields") > 0) & low_field,
        F.col("overall_confidence") < config["overall_floor"],
        country.isin(*config["high_risk"]),
        watched,
        ~has_mandatory(),
        F.col("outcome") == "UNSTRUCTURABLE",
    )
    return F.array_compact(F.array(*(F.when(x, F.lit(name)) for x, name in zip(fires, REASONS, strict=True))))


def compliance(df: DataFrame, config: dict = COMPLIANCE) -> DataFrame:
    """Append ``would_decision``, ``primary_reason``, ``reasons``, ``urgency`` and ``decision``.

    ``decision`` is what takes effect: BYPASS in shadow mode or if switched
    off. A row whose inputs are missing takes the fail-safe way.
    """
    none = F.array().cast("array<string>")
    broken = F.col("fields").isNull() | F.col("raw").isNull() | F.col("overall_confidence").isNull() | F.col("outcome").isNull()
    careful = config["fail_safe"] == "CONSERVATIVE"
    reasons = F.when(broken, F.array(F.lit("UNSTRUCTURABLE")) if careful else none).otherwise(compliance_reasons(config))
    if not config["enabled"]:
        reasons, broken = none, F.lit(False)
    df = df.withColumn("reasons", reasons)
    hurried = F.array_contains("reasons", "SANCTIONS_PATTERN_MATCH") | F.array_contains("reasons", "HIGH_RISK_COUNTRY")
    df = df.withColumns(
        {
            "would_decision": F.when(F.size("reasons") == 0, "BYPASS").otherwise("ROUTE"),
            "primary_reason": F.get("reasons", F.lit(0)),
            "urgency": F.when(F.size("reasons") == 0, F.lit(None).cast("string")).when(broken, "BLOCKING").when(hurried, "EXPEDITED").otherwise("STANDARD"),
        }
    )
    shadowed = F.lit(bool(config["shadow"])) & ~broken
    return df.withColumns({"decision": F.when(shadowed, "BYPASS").otherwise(F.col("would_decision")), "evaluated_by_service": F.col("outcome") != "UNSTRUCTURABLE"})


def pattern_hits(df: DataFrame, patterns: tuple[str, ...] = COMPLIANCE["patterns"], raw: str = "raw") -> Column:
    """Which of the watched patterns occur, for audits."""
    return F.array_compact(F.array(*(F.when(F.upper(raw).rlike("(?i)" + p), F.lit(p)) for p in patterns)))


# Format rules


def format_issues(country: str = "country") -> Column:
    """Issues of a structured address against its country's rules: (field, severity, message)."""
    code = F.upper(F.col(country))
    postcode, ctry = field_value("PST_CD"), field_value("CTRY")
    given, bare = ~is_blank(postcode), code.isin(*NO_POSTCODE)
    wrong = F.lit(False)
    for c, p in POSTCODES.items():
        wrong = wrong | ((code == c) & ~postcode.rlike(p))

    def issue(when: Column, field: str, severity: str, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), message.alias("message")))

    said = [
        issue(given & wrong, "PST_CD", "WARNING", F.concat(F.lit("postcode "), postcode, F.lit(" does not fit "), code)),
        issue(~given & ~bare & ctry.isNotNull(), "PST_CD", "INFO", F.concat(F.lit("postcode expected for "), code)),
        issue(given & bare, "PST_CD", "WARNING", F.concat(code, F.lit(" has no postcodes, got "), postcode)),
        issue(F.length(ctry) != 2, "CTRY", "ERROR", F.concat(F.lit("country code must have two letters, got "), ctry)),
        *(issue(~F.coalesce(F.map_contains_key("fields", F.lit(f)), F.lit(False)), f, "ERROR", F.lit(f"{f} is mandatory")) for f in MANDATORY),
    ]
    none = F.array().cast("array<struct<field:string,severity:string,message:string>>")
    return F.when(is_blank(F.col(country)), none).otherwise(F.array_compact(F.array(*said)))


def issues_table(df: DataFrame, key: str = "request_id", country: str = "country") -> DataFrame:
    return df.select(key, F.explode(format_issues(country)).alias("issue")).select(key, "issue.*")


def field_order(field: Column) -> Column:
    """Place of a field in the fixed order."""
    return F.element_at(constant_map({f: k for k, f in enumerate(FIELDS)}), field)
