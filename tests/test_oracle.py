"""Every named query against its SQL in DuckDB."""

import pytest

from siltstone import plans

from .compare import assert_same, assert_same_types, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, sf, name):
    df = plans.QUERIES[name](spark, sf)
    relation = con.sql(plans.ORACLE_SQL[name])
    assert_same_types(df, relation)
    assert_same(df, relation)
