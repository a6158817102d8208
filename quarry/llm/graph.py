"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component): of each node in edges (a long, b long) the smallest node it can reach.

    Each round makes every node point to the smallest of its neighbours, first seen from all larger ones, then from
    all smaller ones, until nothing changes; the number of rounds grows with the logarithm of the longest chain. A
    round aggregates before it shuffles and joins back, so a node with very many links never lies in one task.
    Repeated links, links to itself and links with a null count as given once, not at all and not at all.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e, seen = materialise(e, "links"), None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = e.union(e.select("v", "u"))
        low = both.groupBy(F.col("u").alias("u")).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(low.select("u", "m")).distinct(), "links")
    tops = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
