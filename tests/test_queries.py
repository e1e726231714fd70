"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import compare, connect

from tessera.checks import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FOUND = registry()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_query(spark, con, name):
    query, sql = FOUND[name]
    df = query(spark, SF)
    if sql is None:
        assert df.columns and len(df.collect()) > 0
        return
    _, _, problem = compare(df, con, sql)
    assert problem is None, problem


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    row = entry.entry(spark).first()
    assert row["tiles"] == sum(row[c] for c in ("empty", "interior", "seam", "partial", "too_many"))
