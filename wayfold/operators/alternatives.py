"""Candidates with alternatives: a source's other readings of a field take part in the vote.

``alternatives`` is an array of (value, confidence), by falling confidence; it
may be null. A source counts once for each value that it names, at the best
place where it names it, so two sources agree also where one has the value
only as an alternative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import is_blank, jtrim
from wayfold.operators.consensus import weight
from wayfold.operators.merge import elected
from wayfold.plans.config import STRONG


def ranked(candidates: DataFrame) -> DataFrame:
    """One row a reading: ``rank`` is 0 for the value itself, then the place among the alternatives; blank readings go."""
    own = F.array(F.struct(F.lit(0).alias("rank"), F.col("value").alias("value"), F.col("raw_confidence").alias("raw_confidence")))
    other = F.transform("alternatives", lambda a, i: F.struct((i + 1).alias("rank"), a["value"].alias("value"), a["confidence"].alias("raw_confidence")))
    every = F.filter(F.concat(own, F.coalesce(other, F.array().cast("array<struct<rank:int,value:string,raw_confidence:double>>"))), lambda x: ~is_blank(x["value"]))
    rest = [c for c in candidates.columns if c not in ("value", "raw_confidence", "alternatives", "rank")]
    return candidates.select(*rest, F.explode(every).alias("_e")).select(*rest, "_e.*")


def _once(said: Column) -> Column:
    """Of each source's readings with the same value the best: the most confident, then the first."""
    keys = F.array_distinct(F.transform(said, lambda x: F.struct(x["structurer"], x["norm"])))
    return F.transform(keys, lambda k: F.array_max(F.filter(said, lambda x: F.struct(x["structurer"], x["norm"]) == k)))


def resolve(readings: DataFrame, weights: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """Per request and field: the elected value, where it stood, and how far the sources agree.

    ``readings`` are calibrated rows of ``ranked`` with ``country``. The vote is
    that of ``merge.vote`` over readings: the value that most sources name, else the
    most confident. ``rank`` is the best rank at which a source names it.
    ``shared`` tells whether some value is named by all strong sources (by all,
    if fewer than two are strong); ``choices`` has each source's readings in
    order. One exchange, by request; a group has as many rows as its sources have readings.
    """
    strong = weight(F.col("structurer"), F.coalesce("country", F.lit("")), weights) >= STRONG
    one = F.struct("confidence", (-F.col("cascade_pos")).alias("early"), (-F.col("rank")).alias("first"), "value", jtrim(F.lower("value")).alias("norm"), "structurer", strong.alias("strong"))
    rows = readings.where(~is_blank(F.col("value"))).repartition("request_id")
    rows = rows.groupBy("request_id", "field").agg(F.collect_list(one).alias("_all")).withColumn("_said", _once(F.col("_all")))

    def named(of: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(of, lambda x: x["structurer"])))

    strict = F.filter("_all", lambda x: x["strong"])
    judges = F.when(F.size(named(strict)) < 2, F.col("_all")).otherwise(strict)
    rows = rows.withColumns({"_names": named(F.col("_all")), "_judges": judges})
    norms = F.array_distinct(F.transform("_judges", lambda x: x["norm"]))
    shared = F.exists(norms, lambda v: F.size(named(F.filter("_judges", lambda x: x["norm"] == v))) == F.size(named(F.col("_judges"))))

    def order(of: Column) -> Column:
        places = F.array_sort(F.transform(of, lambda x: F.struct((-x["first"]).alias("rank"), x["value"].alias("value"))))
        return F.transform(places, lambda x: x["value"])

    choices = F.map_from_arrays("_names", F.transform("_names", lambda s: order(F.filter("_all", lambda x: x["structurer"] == s))))
    won = elected(rows.withColumns({"shared": shared, "choices": choices}), "_said", F.size("_names"))
    rank = F.array_min(F.transform(F.filter("_all", lambda x: x["norm"] == jtrim(F.lower(F.col("_won.value")))), lambda x: -x["first"]))
    return won.select("request_id", "field", "_won.*", "sources", rank.alias("rank"), "shared", "choices")
