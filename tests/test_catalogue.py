"""Every query of the catalogue against its SQL on the smallest data set."""

import os

import pytest
from oracle import connect, plain

from harvestry.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    told = duck.execute(sql)
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(told.fetchall(), columns)
