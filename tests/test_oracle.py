"""Every registered query against its SQL text, values and types."""

import pytest
from conftest import TESTDATA

import __spark_entry__ as entry_points
import oracle
from pulseplan.plans.catalog import all_queries
from pulseplan.plans.oracle_sql import all_oracles

QUERIES, ORACLES = all_queries(), all_oracles()
SCALES = [s for s in ("sf0.001", "sf0.01") if (TESTDATA / s).is_dir()]


@pytest.fixture(scope="module", params=SCALES)
def scale(request):
    sf_dir = str(TESTDATA / request.param)
    return sf_dir, oracle.connect(sf_dir)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, scale, name):
    sf_dir, connection = scale
    assert oracle.compare(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) == []


def test_flagship_query_returns_rows(spark):
    assert entry_points.entry(spark).count() > 0
