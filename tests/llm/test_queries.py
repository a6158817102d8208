"""The registered queries as they are: on the test tables, against their SQL, and what they give for them."""

import os

import pytest

import __spark_entry__ as contract
from quarry.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op1_decontaminate"}))
def test_each_document_has_its_row(spark, name):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in QUERIES[name](spark, DATA).select("doc_id").collect()) == ids


def test_personal_data_of_the_tables(spark):
    import brute

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    some = 0
    for r in QUERIES["op10_pii"](spark, DATA).collect():
        want = brute.pii(texts[r["doc_id"]])
        some += len(want)
        assert r["base_sha256"] == brute.sha(",".join(want)) and set(want) <= set(r["spans"].split(","))
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(want)
    assert some


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
