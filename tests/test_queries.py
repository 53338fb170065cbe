"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    frame = entry.queries()[name](spark, SF).toPandas()
    assert difference(frame, con.execute(entry.oracle_sql()[name]).df()) is None
