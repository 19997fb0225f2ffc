"""Small constant tables as map literals: lookups without a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant_map(values: dict) -> Column:
    """A map literal of fixed configuration."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def lookup(values: dict, *keys: Column) -> Column:
    """The value of the first key that is present, else null."""
    if not values:
        return F.lit(None)
    table = constant_map(values)
    return F.coalesce(*(F.try_element_at(table, k) for k in keys))
