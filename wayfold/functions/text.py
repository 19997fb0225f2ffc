"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\x00-\x20]+|[\x00-\x20]+$"


def jtrim(c: Column) -> Column:
    """Strip every character up to U+0020 from both ends; the built-in trim strips spaces only."""
    return F.regexp_replace(c, _EDGE, "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.length(jtrim(c)) == 0)


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def tidy(c: Column) -> Column:
    """Trimmed, single-spaced, without trailing punctuation."""
    return jtrim(F.regexp_replace(collapse(jtrim(c)), r"[,;.]+$", ""))


def canonical(c: Column) -> Column:
    """The form in which two raw addresses are the same."""
    return F.lower(collapse(jtrim(c)))


def dedup_key(raw: Column, hint: Column) -> Column:
    """SHA-256 of canonical text and hint; the channel plays no part."""
    return F.sha2(F.concat(canonical(raw), F.lit("|"), F.coalesce(hint, F.lit(""))), 256)


def clean_hint(hint: Column) -> Column:
    """Upper case if two letters, else empty."""
    up = F.upper(F.coalesce(hint, F.lit("")))
    return F.when(up.rlike(r"^[A-Z]{2}$"), up).otherwise("")


def join_lines(*lines: Column) -> Column:
    """Trimmed lines that are not blank, joined by a comma."""
    return F.array_join(F.filter(F.array(*(jtrim(F.coalesce(x, F.lit(""))) for x in lines)), lambda x: x != ""), ", ")


def split_parts(c: Column, by: str = ",") -> Column:
    """Trimmed parts; empty parts at the end are dropped."""
    kept = F.regexp_replace(c, rf"(?:{by}\s*)+$", "")
    return F.transform(F.split(kept, by), jtrim)


def rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression rewrites."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def replace_all(template: Column, values: dict[str, Column]) -> Column:
    """Fill ``{{name}}`` places of a template."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return template


def first_match(raw: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    found = F.regexp_extract(raw, pattern, group)
    return F.when(found != "", found)


def without_marks(c: Column) -> Column:
    """Letters without diacritics: compatibility decomposition, marks dropped. Spark has no such function, so Arrow batches go through Python."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else "".join(x for x in unicodedata.normalize("NFKD", v) if not unicodedata.combining(x)))

    return plain(c)
