"""How far the sources of a request agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import is_blank, jtrim
from wayfold.operators.lookup import lookup
from wayfold.plans.config import SOURCE_WEIGHTS, STRONG


def weight(structurer: Column, country: Column, weights: dict[tuple[str, str], float] | None = None) -> Column:
    """Weight of a source in a country, else its default, else 1."""
    table = {f"{s}|{c}": w for (s, c), w in (SOURCE_WEIGHTS if weights is None else weights).items()}
    if not table:
        return F.lit(1.0)
    return F.coalesce(lookup(table, F.concat(structurer, F.lit("|"), F.upper(country)), F.concat(structurer, F.lit("|default"))), F.lit(1.0))


def by_field(candidates: DataFrame, weights: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """Per request and field: whether the sources agree, and what each said if not.

    A lone source agrees if it is strong. Different values disagree only if two
    or more of them have a strong source. ``country`` is the hint, else the
    merged country, and comes with the candidates. Of several values of one
    source the alternatives name the first in order.
    """
    rows = candidates.where(~is_blank(F.col("value"))).withColumns({"_norm": jtrim(F.lower("value")), "_strong": weight(F.col("structurer"), F.coalesce("country", F.lit("")), weights) >= STRONG})
    one = F.struct("structurer", "value", F.col("_norm").alias("norm"), F.col("_strong").alias("strong"))
    # a group has as many rows as a request has sources
    said = rows.repartition("request_id").groupBy("request_id", "field").agg(F.collect_list(one).alias("_said"))

    def values(of: Column) -> Column:
        return F.size(F.array_distinct(F.transform(of, lambda x: x["norm"]))).cast("long")

    groups = said.select("request_id", "field", "_said", F.size("_said").cast("long").alias("n_sources"), values(F.col("_said")).alias("n_values"), values(F.filter("_said", lambda x: x["strong"])).alias("n_strong_values"))
    agreed = F.when(F.col("n_sources") == 1, F.col("n_strong_values") == 1).otherwise((F.col("n_values") == 1) | (F.col("n_strong_values") < 2))
    quiet = F.when(F.col("n_sources") == 1, agreed).otherwise(F.col("n_values") == 1)
    names = F.array_distinct(F.transform(F.array_sort("_said"), lambda x: x["structurer"]))
    first = F.map_from_entries(F.transform(names, lambda s: F.struct(s.alias("key"), F.get(F.filter(F.array_sort("_said"), lambda x: x["structurer"] == s), F.lit(0))["value"].alias("value"))))
    empty = F.map_filter(first, lambda k, v: F.lit(False))
    return groups.select("request_id", "field", agreed.alias("agreed"), "n_sources", "n_values", "n_strong_values", F.when(quiet, empty).otherwise(first).alias("alternatives"))


def by_request(fields: DataFrame, candidates: DataFrame, weights: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """Counts, ratio, flagged fields, sources and their weights of each request."""
    own = fields.groupBy("request_id").agg(
        F.count_if("agreed").alias("agreements"),
        F.count_if(~F.col("agreed")).alias("disagreements"),
        F.array_sort(F.collect_list(F.when(~F.col("agreed"), F.col("field")))).alias("flagged_fields"),
    )
    sources = candidates.repartition("request_id").groupBy("request_id").agg(F.array_sort(F.collect_set("structurer")).alias("_sources"), F.array_min(F.collect_set(F.coalesce("country", F.lit("")))).alias("_country"))
    both = sources.join(own, "request_id", "left")
    n, m = F.coalesce("agreements", F.lit(0)), F.coalesce("disagreements", F.lit(0))
    return both.select(
        "request_id",
        n.cast("long").alias("agreements"),
        m.cast("long").alias("disagreements"),
        F.when(n + m > 0, n / (n + m)).otherwise(0.0).alias("overall_consensus"),
        F.size("_sources").cast("long").alias("source_count"),
        F.coalesce("flagged_fields", F.array().cast("array<string>")).alias("flagged_fields"),
        F.map_from_arrays("_sources", F.transform("_sources", lambda s: weight(s, F.col("_country"), weights))).alias("weights"),
    )


def within(heard: str, country: Column, weights: dict[tuple[str, str], float] | None = None) -> Column:
    """The same as ``by_field`` and ``by_request`` for one request: of an array of (field, said: array of (structurer, norm)) the counts, ratio, flagged fields, sources and weights."""

    def agrees(said: Column) -> Column:
        strong = F.filter(said, lambda x: weight(x["structurer"], country, weights) >= STRONG)
        kinds = F.size(F.array_distinct(F.transform(said, lambda x: x["norm"])))
        return F.when(F.size(said) == 1, F.size(strong) == 1).otherwise((kinds == 1) | (F.size(F.array_distinct(F.transform(strong, lambda x: x["norm"]))) < 2))

    judged = F.transform(F.filter(heard, lambda h: F.size(h["said"]) > 0), lambda h: F.struct(h["field"].alias("field"), agrees(h["said"]).alias("agreed")))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(heard, lambda h: F.transform(h["said"], lambda x: x["structurer"])))))

    def summed(x: Column) -> Column:
        n, m = (F.size(F.filter(x["judged"], test)).cast("long") for test in (lambda f: f["agreed"], lambda f: ~f["agreed"]))
        return F.struct(
            n.alias("agreements"),
            m.alias("disagreements"),
            F.when(n + m > 0, n / (n + m)).otherwise(0.0).alias("overall_consensus"),
            F.size(x["names"]).cast("long").alias("source_count"),
            F.array_sort(F.transform(F.filter(x["judged"], lambda f: ~f["agreed"]), lambda f: f["field"])).alias("flagged_fields"),
            F.map_from_arrays(x["names"], F.transform(x["names"], lambda s: weight(s, country, weights))).alias("weights"),
        )

    return F.when(F.size(names) > 0, F.element_at(F.transform(F.array(F.struct(judged.alias("judged"), names.alias("names"))), summed), 1))


def short_of_sources(requests: DataFrame, least: int = 2) -> DataFrame:
    return requests.where(F.col("source_count") < least)
