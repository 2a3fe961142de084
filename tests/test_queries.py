"""Every query of the engine against the SQL that states its result, and the entry points."""

import __spark_entry__ as entry
import pytest
from helpers import oracle_rows, rows_of

from statelog.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, data, name):
    names, rows = rows_of(catalog.QUERIES[name](spark, data))
    assert (names, rows) == oracle_rows(catalog.SQL[name], data)


def test_every_query_is_registered_with_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_point_filter_reaches_the_scan(spark, data):
    from statelog.operators import state

    log = catalog.event_log(spark, data).withColumn("key", catalog.F.col("kind"))
    plan = state.get(log, "click")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan.replace(" ", "")
