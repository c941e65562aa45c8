"""Every query that has a SQL form gives the same rows on both engines."""

import pytest

from contract.compare import differences, open_tables
from contract.oracle import ORACLE
from contract.queries import QUERIES


@pytest.fixture(scope="module")
def con(tiny):
    return open_tables(tiny)


def test_every_sql_form_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


# The closed form of least squares needs regressors that vary in every series.
LARGER = {"ols_flags", "ols_moments_one_regressor"}


@pytest.mark.parametrize("name", sorted(set(ORACLE) - LARGER))
def test_same_rows(spark, con, tiny, name):
    assert differences(spark, con, tiny, name) == []


@pytest.mark.parametrize("name", sorted(LARGER))
def test_same_rows_larger(spark, small, name):
    assert differences(spark, open_tables(small), small, name) == []
