"""What the driver calls: every query has a name once, its SQL belongs to it, and missing parts are left out."""

import importlib

import __spark_entry__ as entry

from wayfold.plans import queries as own


def test_sql_belongs_to_queries():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and set(own.QUERIES) <= set(known)
    assert set(own.QUERIES) == set(own.ORACLES)


def test_optional_parts_that_cannot_be_imported_are_left_out(monkeypatch):
    real = importlib.import_module

    def broken(name, *args):
        if name.startswith(("wayfold.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", broken)
    assert set(entry.queries()) == set(own.QUERIES) and set(entry.oracle_sql()) == set(own.ORACLES)


def test_reports_sort_nulls_as_largest(spark):
    from pyspark.sql import functions as F

    from wayfold.operators import reports

    df = spark.createDataFrame([("US", "0.55"), (None, "0.55"), ("AE", "0.55")], "country string, c string").select("country", F.col("c").cast("decimal(3,2)").alias("overall_confidence"), F.current_timestamp().alias("created_at"))
    rows = reports.confidence_histogram(df, reports.latest(df, "created_at")).collect()
    assert [r.country for r in rows] == ["AE", "US", None]
