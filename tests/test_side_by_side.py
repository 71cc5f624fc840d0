"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    state, _, _ = check.compare(spark, sf_dir, name)
    assert state == "ok"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).where("is_anomaly").count() == 70
