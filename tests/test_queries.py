"""Every query beside its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

from termloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    f = catalog.QUERIES[name]
    if name in catalog.ORACLE_SQL:
        assert compare(spark, db, f, catalog.ORACLE_SQL[name], SF) == ""
    else:
        assert f(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
