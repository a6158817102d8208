import random

import brute
import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from quarry.llm import minhash_dedup as m
from quarry.llm.graph import components


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def near_copies(n, base, edits, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("shingle", [2, 5])
def test_equals_brute_force(spark, shingle):
    texts = [" ".join(words(random.Random(i).randrange(1, 80), i)) for i in range(60)]
    texts += near_copies(60, words(150, 1), 14, 2) + near_copies(30, words(40, 3), 5, 4) + [texts[0]] * 5 + ["", " ", "solo", "solo", None]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert found(m.near_duplicates(df, shingle)) == brute.components(docs, shingle)


def test_a_large_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 16)
    docs = dict(enumerate(near_copies(150, words(120, 5), 18, 6)))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert found(m.near_duplicates(df, 2)) == brute.components(docs, 2)


def test_odd_input(odd_docs, no_docs):
    rows = m.near_duplicates(odd_docs, 2).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert by[7]["component_id"] == 6
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (3, 4, 5))
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert m.near_duplicates(no_docs, 2).collect() == []


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        common = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
        n = int(2000 * (1 - share) / (2 * share))
        a, b = (np.unique(np.concatenate([common, r.integers(0, 1 << 63, n, dtype=np.uint64)])) for _ in range(2))
        s = m.odd_sketches(np.stack([m.minhash(a), m.minhash(b)]))
        bits = bin(int(np.bitwise_xor(s[0], s[1]).view(np.uint64)[0])).count("1") + sum(bin(int(x)).count("1") for x in np.bitwise_xor(s[0], s[1]).view(np.uint64)[1:])
        assert m.most_odd_bits(share + 0.15) <= bits <= m.most_odd_bits(share - 0.15)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long").select(F.col("a"), F.col("b"))).count() == 0


def test_shared_counts():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 9000, n)) for n in (0, 1, 50, 5000, 7000)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[1:]]
    assert m.shared_counts(sets[1:], sets).tolist() == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_join(spark, monkeypatch, how):
    from quarry.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = spark.createDataFrame([(i, i % 7 if i % 2 else 3, i % 3) for i in range(300)] + [(999, None, 0)], "v long, a long, b long")
    unique = rows.where("a is not null and a != 5").groupBy("a", "b").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    assert unique.where("n > 20").count() and unique.where("n <= 20").count()
    want = sorted(map(tuple, rows.join(unique.drop("n"), ["a", "b"], how).select("v", "a", "b", "total").na.fill(-1).collect()))
    got = common.spread_join(rows, unique, ["a", "b"], 300, how)
    assert got.columns == ["v", "a", "b", "total"] and sorted(map(tuple, got.na.fill(-1).collect())) == want


def test_very_long_texts_take_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 16)
    monkeypatch.setattr(m, "WEIGHT", 10)
    docs = dict(enumerate(near_copies(40, words(200, 8), 25, 9) + near_copies(10, words(90, 10), 9, 11)))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert found(m.near_duplicates(df, 2)) == brute.components(docs, 2)


def test_one_row_of_each_group_stays(spark, odd_docs, no_docs):
    a, b = " ".join(words(90, 1)), " ".join(words(90, 2))
    rows = [(5, a), (5, b), (3, a + " end"), (5, a), (9, b + " end"), (None, b), (None, " ".join(words(50, 3))), (7, None), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as `a.b`", "2 as _row")
    kept = m.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(3, a + " end"), (5, b), (0, " ".join(words(50, 3))), (7, None), (7, None), (8, "")], key=str)
    assert m.keep_one(odd_docs).columns == odd_docs.columns and m.keep_one(no_docs).collect() == []
