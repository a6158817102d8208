"""Registered queries return the whole of their input."""

import os

import pytest

from quarry.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@tables
def test_all_merged_rows_come(spark):
    n = sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("conversations", "pages"))
    assert QUERIES["merge_elements"](spark, DATA).count() == n


def test_columns_of_any_number(spark):
    from quarry.functions import sheets

    def letter(n):
        s = ""
        while n > 0:
            n, r = divmod(n - 1, 26)
            s = chr(65 + r) + s
        return s or "A"

    ns = [-1, 0, 1, 26, 27, 702, 703, 18278, 18279, 20000, 475254, 475255, 2**62]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    assert {r[0]: r[1] for r in df.select("n", sheets.column_letter(df["n"])).collect()} == {n: letter(n) for n in ns}


def test_column_letters_has_every_part(spark, tmp_path):
    import duckdb

    keys = [*range(-1, 30), *range(18270, 18290), 20000, 475255, 7199999]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    found = [tuple(r) for r in QUERIES["column_letters"](spark, str(tmp_path)).collect()]
    assert sorted(k for k, _ in found) == keys

    # The SQL stops before four letters; as far as it goes it has the same.
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert set(con.sql(ORACLES["column_letters"]).fetchall()) <= set(found)


def test_column_letters_keeps_rows_without_key_and_repeated_ones(spark, tmp_path):
    keys = [None, 7, 7, 18279, 18279, 2**63 - 1]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    found = [tuple(r) for r in QUERIES["column_letters"](spark, str(tmp_path)).collect()]
    want = [(None, None), (7, "G"), (7, "G"), (18279, "AAAA"), (18279, "AAAA"), (2**63 - 1, "CRPXNLSKVLJFHG")]
    assert sorted(found, key=str) == sorted(want, key=str)


@tables
def test_whole_texts_reach_the_operators(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "text")
    figures = QUERIES["figure_texts"](spark, DATA).join(turns, ["conv_id", "turn"])
    assert figures.where("endswith(figure, text)").count() == figures.count() > 0


@tables
@pytest.mark.parametrize("name", ["knn_batched_cosine", "knn_batched_dot"])
def test_every_fiftieth_vector_is_a_query(spark, name):
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    assert {r["query_id"] for r in QUERIES[name](spark, DATA).collect()} == ids != set()
