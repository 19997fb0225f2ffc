"""Every registered query of the structuring package against its SQL."""

import oracle
import pytest

from wayfold.plans import ingest_queries  # noqa: F401
from wayfold.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    df = q.QUERIES[name](spark, sf_dir)
    if name not in q.ORACLES:
        assert df.count() > 0
        return
    assert oracle.difference(df, q.ORACLES[name], sf_dir) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
