"""Defaults of the structuring plan: plain data, replaceable by the caller.

The values below are fixed: codes, thresholds, patterns and rule names that
results depend on.
"""

from __future__ import annotations

FIELDS = ("CTRY", "TWN_NM", "PST_CD", "CTRY_SUB_DVSN", "STRT_NM", "BLDG_NB", "BLDG_NM", "ADR_LINE")
MANDATORY = ("CTRY", "TWN_NM")
CHANNELS = ("HTTP", "KAFKA", "RABBITMQ", "BACKFILL")
MAX_RAW = 2000
MAX_BATCH = 100
STRONG = 0.5
REVIEW_THRESHOLD = 0.70

STRUCTURERS = ("libpostal", "glm", "azure-gpt")
ROUTING = {country: ("glm", "azure-gpt", "libpostal") for country in ("CN", "AE", "HK", "SG")}
SOURCE_WEIGHTS = {
    ("libpostal", "default"): 0.3,
    **{("libpostal", c): 1.0 for c in ("US", "GB", "DE", "CH", "FR", "IT", "NL", "AU", "CA", "AT", "BE", "ES", "PT", "SE", "NO", "DK", "FI")},
    ("glm", "default"): 1.0,
    ("azure-gpt", "default"): 1.0,
}

REVIEW_RULES = (
    {"name": "low-confidence", "enabled": True, "type": "LOW_CONFIDENCE", "description": "Overall confidence below threshold", "params": {"threshold": 0.70}},
    {"name": "missing-mandatory", "enabled": True, "type": "MISSING_FIELDS", "description": "SR2026 mandatory fields missing", "params": {"fields": "CTRY,TWN_NM"}},
    {"name": "consensus-disagreement", "enabled": True, "type": "CONSENSUS_DISAGREEMENT", "description": "Strong sources disagree on 2+ fields", "params": {"min-disagreements": 2}},
    {"name": "single-source", "enabled": True, "type": "SINGLE_SOURCE", "description": "Fewer than required sources returned results", "params": {"min-sources": 2}},
    {"name": "high-risk-country", "enabled": True, "type": "HIGH_RISK_COUNTRY", "description": "Address in high-risk jurisdiction", "params": {"countries": "IR,KP,SY,CU,AF,YE,VE,MM,RU,BY"}},
    {"name": "field-confidence-floor", "enabled": True, "type": "FIELD_CONFIDENCE_FLOOR", "description": "Critical field below 50% confidence", "params": {"threshold": 0.50, "fields": "CTRY,TWN_NM,STRT_NM"}},
)

COMPLIANCE = {
    "enabled": True,
    "field_floors": {"CTRY": 0.95, "TWN_NM": 0.80, "CTRY_SUB_DVSN": 0.75},
    "overall_floor": 0.85,
    "high_risk": ("IR", "KP", "SY", "CU", "RU", "BY", "VE", "MM", "SD", "SO", "YE", "LY", "AF"),
    "patterns": (
        r"CENTRAL\s+BANK\s+OF\s+IRAN",
        r"BANK\s+MELLI",
        r"BANK\s+SADERAT",
        r"KOREAN\s+WORKERS.?\s*PARTY",
        r"ATOMIC\s+ENERGY\s+ORGANIZATION",
        "IRGC",
        r"ISLAMIC\s+REVOLUTIONARY\s+GUARD",
    ),
    "fail_safe": "CONSERVATIVE",
    "shadow": True,
}
REASONS = ("LOW_FIELD_CONFIDENCE", "LOW_OVERALL_CONFIDENCE", "HIGH_RISK_COUNTRY", "SANCTIONS_PATTERN_MATCH", "SCHEMA_INCOMPLETE", "UNSTRUCTURABLE")

POSTCODES = {
    "US": r"^\d{5}(-\d{4})?$",
    "GB": r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}$",
    "DE": r"^\d{5}$",
    "CH": r"^\d{4}$",
    "FR": r"^\d{5}$",
    "SG": r"^\d{6}$",
    "CN": r"^\d{6}$",
    "JP": r"^\d{3}-?\d{4}$",
    "AU": r"^\d{4}$",
    "CA": r"(?i)^[A-Z]\d[A-Z]\s?\d[A-Z]\d$",
    "IN": r"^\d{6}$",
    "BR": r"^\d{5}-?\d{3}$",
    "IT": r"^\d{5}$",
    "ES": r"^\d{5}$",
    "NL": r"(?i)^\d{4}\s?[A-Z]{2}$",
}
NO_POSTCODE = (
    "AE", "HK", "IE", "QA", "BH", "OM", "AG", "AO", "BS", "BZ",
    "BJ", "BW", "CM", "CF", "KM", "CG", "DJ", "GQ", "ER", "FJ",
    "GA", "GM", "GH", "GD", "GN", "GY", "KI", "LY", "MW", "ML",
    "MR", "NR", "RW", "KN", "LC", "ST", "SC", "SL", "SB", "SR",
    "TL", "TG", "TO", "TV", "UG", "VU", "ZW",
)

PARSER_LABELS = {"house_number": "BLDG_NB", "road": "STRT_NM", "city": "TWN_NM", "state": "CTRY_SUB_DVSN", "postcode": "PST_CD", "country": "CTRY", "house": "BLDG_NM"}
PARSER_FIELDS = ("CTRY", "TWN_NM", "PST_CD", "CTRY_SUB_DVSN", "STRT_NM", "BLDG_NB")
RESPONSE_ALIASES = {
    "CTRY": "CTRY",
    "COUNTRY": "CTRY",
    "country": "CTRY",
    "country_code": "CTRY",
    "TWN_NM": "TWN_NM",
    "CITY": "TWN_NM",
    "city": "TWN_NM",
    "town": "TWN_NM",
    "TOWN_NAME": "TWN_NM",
    "PST_CD": "PST_CD",
    "POSTAL_CODE": "PST_CD",
    "postal_code": "PST_CD",
    "zip": "PST_CD",
    "ZIP_CODE": "PST_CD",
    "zipcode": "PST_CD",
    "postcode": "PST_CD",
    "CTRY_SUB_DVSN": "CTRY_SUB_DVSN",
    "STATE": "CTRY_SUB_DVSN",
    "state": "CTRY_SUB_DVSN",
    "province": "CTRY_SUB_DVSN",
    "region": "CTRY_SUB_DVSN",
    "STRT_NM": "STRT_NM",
    "STREET": "STRT_NM",
    "street": "STRT_NM",
    "street_name": "STRT_NM",
    "ADDR_LINE1": "STRT_NM",
    "road": "STRT_NM",
    "BLDG_NB": "BLDG_NB",
    "BUILDING_NUMBER": "BLDG_NB",
    "building_number": "BLDG_NB",
    "house_number": "BLDG_NB",
    "number": "BLDG_NB",
    "BLDG_NM": "BLDG_NM",
    "BUILDING_NAME": "BLDG_NM",
    "building_name": "BLDG_NM",
    "building": "BLDG_NM",
    "ADR_LINE": "ADR_LINE",
    "address_line": "ADR_LINE",
}
GULF_REWRITES = [
    (r"\bSZR\b", "Sheikh Zayed Road"),
    (r"\bSheikh Zayed Rd\b", "Sheikh Zayed Road"),
    (r"\bMaktum Rd\b", "Al Maktoum Road"),
    (r"\bMaktoum Rd\b", "Al Maktoum Road"),
    (r"\bKhalifa St\b", "Khalifa Bin Zayed Road"),
    (r"\bP\.?O\.? Box ([0-9]+)", "PO Box $1"),
    (r"\bUAE\b", "United Arab Emirates"),
    (r"\bU\.A\.E\.?\b", "United Arab Emirates"),
    (r"\bDubai\.?,? UAE\b", "Dubai, United Arab Emirates"),
    (r"\bAbu Dhabi\.?,? UAE\b", "Abu Dhabi, United Arab Emirates"),
    (r"\bAd Dawhah\b", "Doha"),
    (r"\bDXB\b", "Dubai"),
    (r"\bAUH\b", "Abu Dhabi"),
    (r"\bShj\b", "Sharjah"),
    (r"\bRAK\b", "Ras Al Khaimah"),
    (r"\bDIFC\b", "Dubai International Financial Centre"),
    (r"\bDMCC\b", "Dubai Multi Commodities Centre"),
    (r"\bJAFZA\b", "Jebel Ali Free Zone"),
    (r"\bDAFZA\b", "Dubai Airport Free Zone"),
    (r"\bADGM\b", "Abu Dhabi Global Market"),
]
ERROR_STATUS = {
    "BAD_INPUT": 400,
    "VALIDATION": 400,
    "UNAUTHORISED": 401,
    "FORBIDDEN": 403,
    "IDEMPOTENCY_DUPLICATE": 200,
    "CASCADE_NO_RESULT": 422,
    "CONFIDENCE_BELOW_THRESHOLD": 422,
    "REQUIRED_FIELD_MISSING": 422,
    "SCHEMA_MISMATCH": 422,
    "UNSUPPORTED_OPERATION": 422,
    "CIRCUIT_OPEN": 503,
    "BULKHEAD_FULL": 503,
    "UPSTREAM_UNAVAILABLE": 503,
    "UPSTREAM_RATE_LIMITED": 503,
    "EXCEPTION_QUEUE_LOCKED": 503,
    "TIMEOUT": 504,
    "NETWORK": 500,
    "DATABASE_CONNECTION": 500,
    "DATABASE_DEADLOCK": 500,
    "SUBSCRIBER_OVERFLOW": 500,
    "UNKNOWN": 500,
}
RETRYABLE = ("TIMEOUT", "NETWORK", "UPSTREAM_RATE_LIMITED", "UPSTREAM_UNAVAILABLE", "DATABASE_DEADLOCK", "DATABASE_CONNECTION")
TIER_0 = ("AE", "SG", "HK", "CN", "GB", "US", "DE", "CH")
TIERS = {country: 0 for country in TIER_0}
TIER_BARS = {0: 0.80, 1: 0.75, 2: 0.65}
TIER_FIXTURES = {0: 50, 1: 25, 2: 10}
REVIEW_BY_COUNTRY = {"CN": 0.65}
