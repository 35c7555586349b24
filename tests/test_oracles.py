"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import pytest

from shelfspark.plans.catalog import ORACLES, QUERIES
from tests.compare import TESTDATA, compare, duck

SF = f"{TESTDATA}/sf0.001"
ROWS_ONLY = {"d3_knn_approx"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_but_the_listed_ones_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert problem in (None, "no rows on either side"), problem


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 18
    assert set(entry.oracle_sql()) <= set(entry.queries())
