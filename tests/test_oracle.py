"""Every registered query against its SQL statement on DuckDB at sf0.01."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))

from conftest import SF01  # noqa: E402


@pytest.fixture(scope="module")
def con():
    from check_oracle import duck
    return duck(SF01)


def names():
    from fernrec.plans import catalog
    return sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, con, name):
    import __spark_entry__ as E
    from check_oracle import compare
    got = E.queries()[name](spark, SF01).toPandas()
    exp = con.execute(E.oracle_sql()[name]).df()
    assert compare(got, exp) == "OK"
