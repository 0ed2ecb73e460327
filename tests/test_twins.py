"""Every query that has SQL returns the rows that DuckDB does."""

import pytest

from coursemill import plans

from . import twins

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return twins.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_and_sql_agree(spark, con, name):
    assert twins.difference(spark, con, plans.queries()[name], plans.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = plans.queries()[name](spark, SF)
    assert df.columns
    assert df.count() > 0
