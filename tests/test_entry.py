import os

import duckdb
import pytest

import __spark_entry__ as contract
from quarry.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            con.sql(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


def rows(found, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    made = [dict(zip(columns, r, strict=True)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()]
    assert rows(df.collect(), columns) == rows(made, columns)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 10
