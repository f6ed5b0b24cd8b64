"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    problem, n, _ = compare(spark, con, name, SF)
    assert problem is None, problem
    assert n > 0 or name in ()


def test_entry(spark):
    df = entry.entry(spark)
    assert {"class", "precision", "recall"} <= set(df.columns)
    assert df.count() == 2
