"""Exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "dot")
#: Query vectors multiplied with a batch of the corpus at once.
QUERY_BLOCK = 1024
#: Rows of the corpus that a block of queries meets at once: with QUERY_BLOCK, numbers in a task's matrices.
ROW_TILE = 2048


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared Euclidean distance, one minus the cosine (1 for a zero vector), or the negative inner product.

    In doubles, added up in order. Vectors of different length, and nulls, have no distance.
    """
    if metric == "l2":
        d = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    elif metric == "dot":
        d = -_dot(a, b)
    elif metric == "cosine":
        norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
        d = F.when(norm == 0, 1.0).otherwise(1 - _dot(a, b) / norm)
    else:
        raise ValueError(f"metric must be one of {METRICS}")
    return F.when(F.size(a) == F.size(b), d)


def nearest(corpus: DataFrame, query: list[float], k: int = 10, metric: str = "l2", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of corpus nearest to a vector, with their distance; ties by key. One scan and a bounded top-k."""
    if k < 1:
        raise ValueError("k must be positive")
    q = F.lit([float(x) for x in query])
    found = corpus.withColumn("distance", distance(F.col(vector), q, metric)).where("distance is not null")
    return found.orderBy("distance", key).limit(k)


class _Best:
    """The k best rows so far for each query vector: query (a place in q), key and distance, in the order of these.

    A matrix product gives distances up to `slack`. Pairs that it can't rule out are added up in order, so that equal
    vectors have equal distances wherever they stand.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.k, self.metric, self.across = k, metric, np.ascontiguousarray(q.T)
        self.query, self.key, self.distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(len(q), np.inf)
        self.norm, self.product, self.rough = self._prepared(q)

    def _prepared(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Norms, what goes into the product, and where its bounds don't hold."""
        with np.errstate(all="ignore"):
            norm = np.sqrt((x * x).sum(axis=1))
            rough = ~((norm == 0) | ((norm > 1e-75) & (norm < 1e75)))
            return norm, x / np.where(norm == 0, 1, norm)[:, None] if self.metric == "cosine" else x, rough

    def add(self, keys: np.ndarray, x: np.ndarray) -> None:
        rows = self._distinct(keys, x)
        keys, x = keys[rows], x[rows]
        norm, product, rough = self._prepared(x)
        largest = norm[~rough].max(initial=0)
        with np.errstate(all="ignore"):
            near = self.product @ product.T
            if self.metric == "l2":
                near *= -2
                near += norm * norm
                near += (self.norm * self.norm)[:, None]
                scale = (self.norm + largest) ** 2
            else:
                np.subtract(float(self.metric == "cosine"), near, out=near)
                scale = self.norm * largest if self.metric == "dot" else np.ones(len(self.norm))
            near[:, rough] = np.nan
            slack = np.where(self.rough, np.nan, 8 * (x.shape[1] + 8) * np.finfo(float).eps * scale)
            open_ = ~(near > (self.worst + slack)[:, None])  # what isn't a number stays open
            if self.k < len(x) and np.count_nonzero(open_) > 4 * self.k * len(slack):
                kth = np.partition(near, self.k - 1, axis=1)[:, self.k - 1]
                open_ = ~(near > (np.fmin(self.worst, kth + slack) + slack)[:, None])
        query, row = np.nonzero(open_)
        self._merge(query, keys[row], self._distances(query, np.ascontiguousarray(x.T), row))

    def _distinct(self, keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Rows without those of which k equal ones with smaller keys are there."""
        if not x.shape[1]:
            return np.argsort(keys)[: self.k]
        _, group = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_inverse=True)
        order = np.lexsort((keys, group))
        return order[_places(group[order]) < self.k]

    def _distances(self, query: np.ndarray, across: np.ndarray, row: np.ndarray) -> np.ndarray:
        def dot(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
            total = np.zeros(len(i))
            for u, v in zip(a, b, strict=True):
                total += u[i] * v[j]
            return total

        with np.errstate(all="ignore"):
            if self.metric == "l2":
                total = np.zeros(len(query))
                for u, v in zip(self.across, across, strict=True):
                    total += (u[query] - v[row]) ** 2
                return total
            total = dot(self.across, query, across, row)
            if self.metric == "dot":
                return -total
            qs, rows = np.arange(self.across.shape[1]), np.arange(across.shape[1])
            norm = np.sqrt(dot(self.across, qs, self.across, qs))[query] * np.sqrt(dot(across, rows, across, rows))[row]
            return np.where(norm == 0, 1.0, 1 - total / np.where(norm == 0, 1, norm))

    def _merge(self, query: np.ndarray, key: np.ndarray, distance: np.ndarray) -> None:
        query, key, distance = np.concatenate([self.query, query]), np.concatenate([self.key, key]), np.concatenate([self.distance, distance])
        order = np.lexsort((key, distance, query))
        place = _places(query[order])
        kept = order[place < self.k]
        self.query, self.key, self.distance = query[kept], key[kept], distance[kept]
        last = order[place == self.k - 1]
        self.worst[query[last]] = distance[last]


def _places(sorted_: np.ndarray) -> np.ndarray:
    """How many equal numbers stand before each one."""
    n = np.arange(len(sorted_))
    first = np.ones(len(sorted_), bool)
    first[1:] = sorted_[1:] != sorted_[:-1]
    return n - np.maximum.accumulate(np.where(first, n, 0))


def nearest_batch(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """(query_id, key, distance, rank) of the k nearest rows for each query vector.

    Queries go over the corpus in blocks of QUERY_BLOCK, so what is shipped is bounded, and meet ROW_TILE of its rows at
    once; each task keeps its k best for each query, and those meet in the end. Distances are added up as by distance().
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    found, block = None, []

    def search(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block], np.int64)
        q = np.array([r[1] for r in block], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(q, k, metric)
            for batch in batches:
                for start in range(0, batch.num_rows, ROW_TILE):
                    part = batch.slice(start, ROW_TILE)
                    there = pc.equal(pc.list_value_length(part.column(1)), q.shape[1]).fill_null(False)
                    keys, lists = part.column(0).filter(there), part.column(1).filter(there)
                    if len(keys):
                        best.add(keys.to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), q.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.key), pa.array(best.distance)], names=["query", "key", "distance"])

        return corpus.select(F.col(key).cast("long"), vector).mapInArrow(run, "query long, key long, distance double")

    for r in queries.select(F.col(query_key).cast("long"), vector).toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            found = search(block) if found is None else found.union(search(block))
            block = []
    if block or found is None:
        if not block:
            return queries.sparkSession.createDataFrame([], f"{query_key} long, {key} long, distance double, rank int")
        found = search(block) if found is None else found.union(search(block))
    order = Window.partitionBy("query").orderBy("distance", "key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_key), F.col("key").alias(key), "distance", "rank")


def grouped_hits(hits: DataFrame, group: str, order: list[str], item: Column, value: str = "items") -> DataFrame:
    """Ranked hits by group, groups in the order of their best hit: (group, first_rank, hits, value).

    hits is the bounded result of a top-k, so its window over all rows is small.
    """
    ranked = hits.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    grouped = ranked.groupBy(group).agg(F.min("_rank").alias("first_rank"), F.count("*").alias("hits"), F.array_sort(F.collect_list(F.struct("_rank", item.alias("item")))).alias("s"))
    return grouped.select(group, "first_rank", "hits", F.transform("s", lambda x: x["item"]).alias(value)).orderBy("first_rank")
