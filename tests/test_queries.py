"""Every registered query of the library: equal to its SQL where it has one, else it gives rows with a stable schema."""

import pytest

from heddle.plans import registry
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.there(), reason="no fixture tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    oracle.compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, oracle.SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
