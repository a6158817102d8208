"""Streams of elements from several extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_number


def uncovered(pages: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that the first extractor has nothing for."""
    return pages.join(covered.select(keys), keys, "left_anti")


def merged(*streams: DataFrame, page: str = "page_or_sheet", order: str = "seq") -> DataFrame:
    """All streams, with `source_rank`, sorted by page number; on a page by stream, then by each stream's own order."""
    every = None
    for i, s in enumerate(streams):
        s = s.withColumn("source_rank", F.lit(i))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    return every.orderBy(page_number(F.col(page)), "source_rank", order)


def ordered_array(elements: DataFrame, key: str, order: list[str], fields: list[str], name: str = "elements") -> DataFrame:
    """(key, name): each document's elements as an array in their order, as the folds and chunkers take them."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("_e"))))
    return elements.groupBy(key).agg(packed.alias("s")).select(key, F.transform("s", lambda x: x["_e"]).alias(name))


def extraction_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("extracted_by").agg(F.count("*").alias("n"))


def type_breakdown(chunks: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, element_type, n, mean_tokens): the mean is rounded down."""
    return chunks.groupBy(key, "element_type").agg(F.count("*").alias("n"), F.expr("sum(token_count) div count(*)").alias("mean_tokens"))
