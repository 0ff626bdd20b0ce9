import pytest

from clastix.plans import density, names, peaks, ranges, ranks, taxonomy  # noqa: F401
from clastix.plans.registry import ORACLES, QUERIES

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
