import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import knn


@pytest.fixture(scope="module")
def corpus(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((200, 8)).astype(np.float32)
    v[50] = v[7]
    v[60] = 0
    df = spark.createDataFrame([(i, x.tolist(), i % 5) for i, x in enumerate(v)] + [(900, None, 1), (901, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    return df, v


def plain(v, q, metric):
    v, q = v.astype(float), q.astype(float)
    if metric == "l2":
        return ((v - q) ** 2).sum(axis=1)
    dot = v @ q
    if metric == "dot":
        return -dot
    norm = np.linalg.norm(v, axis=1) * np.linalg.norm(q)
    return np.where(norm == 0, 1, 1 - dot / np.where(norm == 0, 1, norm))


@pytest.mark.parametrize("metric", knn.METRICS)
def test_nearest(corpus, metric):
    df, v = corpus
    d = plain(v, v[7], metric)
    want = sorted(range(200), key=lambda i: (round(d[i], 9), i))[:10]
    rows = knn.nearest(df, v[7].tolist(), 10, metric).collect()
    assert [r["vec_id"] for r in rows] == want and np.allclose([r["distance"] for r in rows], d[want], atol=1e-9)


@pytest.mark.parametrize("metric", knn.METRICS)
def test_batch_in_blocks(spark, corpus, metric, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    df, v = corpus
    ids = [3, 7, 11, 19, 100, 150, 199]
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in ids], "query_id long, embedding array<float>")
    got = {}
    for r in knn.nearest_batch(df, queries, 4, metric).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for i in ids:
        d = plain(v, v[i], metric)
        assert np.allclose(d[[got[i][k] for k in range(1, 5)]], np.sort(d)[:4], atol=1e-9)
    assert knn.nearest_batch(df, queries.where("false"), 4, metric).collect() == []


def test_bad_arguments(corpus):
    with pytest.raises(ValueError):
        knn.nearest(corpus[0], [1.0], 0)
    with pytest.raises(ValueError):
        knn.nearest(corpus[0], [1.0], 1, "hamming")


@pytest.mark.parametrize("metric", knn.METRICS)
def test_a_task_holds_tiles_and_not_a_whole_batch(spark, monkeypatch, metric):
    r = np.random.default_rng(2)
    x = r.standard_normal((10_000, 4)).astype(np.float32)
    x[1::2] = x[1]  # copies: the smallest keys first
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1000)], "query_id long, embedding array<float>")
    frame, held = type(queries), []
    plain_map = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: held.append(f) or plain_map(self, f, *a, **b))
    knn.nearest_batch(spark.createDataFrame([(0, [0.0])], "vec_id long, embedding array<float>"), queries, 3, metric)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(x), pa.list_(pa.float32()))], names=["vec_id", "embedding"])
    tracemalloc.start()
    out = pa.Table.from_batches(held[0](iter([batch]))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    got = {}
    for q, k in zip(out["query"], out["key"], strict=True):
        got.setdefault(q, []).append(k)
    for q in range(0, 1000, 37):
        d = plain(x, x[q], metric).round(12)
        assert sorted(got[q]) == sorted(sorted(range(10_000), key=lambda i: (d[i], i))[:3])
