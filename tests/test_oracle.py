"""Every named query against its SQL."""

import pytest

from tarnwright.plans import checks, files, metric, more, places, regions, search  # noqa: F401
from tarnwright.plans.catalogue import ORACLES, QUERIES

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, tables, same, name):
    same(QUERIES[name](spark, DATA), tables.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
