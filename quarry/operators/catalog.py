"""The query tools: search, catalog, information on a document, statistics.

The functions on DataFrames are lazy; Tools answers one request with a dict that is fit for JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .enrich import Embedder, HashingEmbedder
from .knn import nearest
from .store import Store

SHOWN_CHARS, SHOWN_SUMMARY, SHOWN_KEYWORDS = 500, 200, 5


def page(catalog: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """A stretch of the catalog, latest first, ties by path; past the end it is short or empty."""
    return catalog.drop("embedding").orderBy(F.desc("indexed_time"), "file_path").offset(skip).limit(limit)


def listed(catalog: DataFrame) -> DataFrame:
    """The columns that a listing shows, with a shortened summary and the first keywords."""
    summary = F.when(F.coalesce("summary", F.lit("")) == "", "No summary").otherwise(F.left("summary", F.lit(SHOWN_SUMMARY)))
    return catalog.select("file_path", "file_name", summary.alias("summary"), F.slice("keywords", 1, SHOWN_KEYWORDS).alias("keywords"), "file_type", "file_size", "total_chunks", "indexed_time")


def chunk_counts(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """The catalog with the number of chunks that the chunk table really holds."""
    counts = chunks.groupBy("file_path").agg(F.count("*").alias("actual_chunks"))
    return catalog.join(counts, "file_path", "left").withColumn("actual_chunks", F.coalesce("actual_chunks", F.lit(0)))


def statistics(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals, zeros where there is nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    docs = catalog.agg(F.count("*").alias("total_documents"), total("file_size"), total("total_chars"), total("total_tokens"))
    return docs.crossJoin(chunks.agg(F.count("*").alias("total_chunks")))  # one row by one row


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """The number of rows of each value that isn't null, most frequent first, ties by value."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


@dataclass
class SearchRequest:
    query: str
    limit: int = 10
    search_type: str = "documents"

    def check(self) -> None:
        if not self.query:
            raise ValueError("query must not be empty")
        if self.limit < 1:
            raise ValueError("limit must be at least 1")
        if self.search_type not in ("documents", "chunks"):
            raise ValueError("search_type must be documents or chunks")


@dataclass
class CatalogRequest:
    skip: int = 0
    limit: int = 100

    def check(self) -> None:
        if self.skip < 0 or self.limit < 1:
            raise ValueError("skip must be at least 0 and limit at least 1")


@dataclass
class DocumentRequest:
    file_path: str

    def check(self) -> None:
        if not isinstance(self.file_path, str):
            raise ValueError("file_path must be a string")


def parsed(kind: type, given: Any) -> Any:
    """A request from an object, a dict or a JSON string; numbers may come as strings."""
    if isinstance(given, str):
        given = json.loads(given)
    if isinstance(given, dict):
        known = {f.name: f.type for f in fields(kind)}
        made = {}
        for k, v in given.items():
            if k in known:
                made[k] = int(v) if known[k] in (int, "int") else v
        try:
            given = kind(**made)
        except TypeError as e:
            raise ValueError(str(e)) from e
    if not isinstance(given, kind):
        raise ValueError(f"expected {kind.__name__}")
    given.check()
    return given


class Tools:
    """Answers requests on a store. Every answer has `success`; a failure has `error` instead of results."""

    def __init__(self, store: Store, embedder: Embedder | None = None, reindex: Callable[[str, bool], dict | None] | None = None):
        self.store, self.embedder, self._reindex = store, embedder or HashingEmbedder(), reindex

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def _answer(self, make: Callable[[], dict]) -> dict:
        try:
            return {"success": True} | make()
        except Exception as e:  # the caller gets every failure as an answer
            return {"success": False, "error": str(e)}

    def search_documents(self, request: Any) -> dict:
        def make() -> dict:
            r = parsed(SearchRequest, request)
            vector = self.embedder.embed([r.query])[0].tolist()
            if r.search_type == "documents":
                hits = nearest(self.store.catalog(), vector, r.limit, key="file_path")
                rows = hits.select("file_path", "file_name", "summary", "keywords", "file_type", "modified_time").collect()
                results: Any = [x.asDict() for x in rows]
            else:
                hits = nearest(self.store.chunks().withColumn("_key", F.struct("file_path", "chunk_id")), vector, r.limit, key="_key")
                rows = hits.select("file_path", "chunk_id", F.left("chunk_text", F.lit(SHOWN_CHARS)).alias("text"), "char_count").collect()
                results = {}
                for x in rows:  # at most `limit`
                    results.setdefault(x["file_path"], []).append({k: x[k] for k in ("chunk_id", "text", "char_count")})
            return {"query": r.query, "search_type": r.search_type, "total_results": len(rows), "results": results}

        return self._answer(make)

    def get_catalog(self, request: Any = None) -> dict:
        def make() -> dict:
            r = parsed(CatalogRequest, request if request is not None else {})
            rows = [x.asDict() for x in listed(page(self.store.catalog(), r.skip, r.limit)).collect()]
            stats = self._totals()
            return {
                "total_documents": stats["total_documents"], "returned": len(rows), "skip": r.skip, "limit": r.limit, "documents": rows,
                "stats": {k: stats[k] for k in ("total_chunks", "total_size_mb", "file_types")},
            }

        return self._answer(make)

    def get_document_info(self, request: Any) -> dict:
        def make() -> dict:
            r = parsed(DocumentRequest, request)
            one = self.store.catalog().drop("embedding").where(F.col("file_path") == r.file_path).limit(1)
            found = chunk_counts(one, self.store.chunks().where(F.col("file_path") == r.file_path)).collect()
            if not found:
                raise LookupError(f"Document not found: {r.file_path}")
            return {"document": found[0].asDict() | {"file_size_mb": round(found[0]["file_size"] / 1048576, 2)}}

        return self._answer(make)

    def reindex_document(self, request: Any, force: bool = False) -> dict:
        """Indexes a file anew. Without force one whose content is known already is refused."""

        def make() -> dict:
            r = parsed(DocumentRequest, request)
            if self._reindex is None:
                raise RuntimeError("no indexer is configured")
            made = self._reindex(r.file_path, force)
            if made is None:
                raise ValueError("Document unchanged")
            return {"file_path": r.file_path, "summary": (made["summary"] or "")[:SHOWN_SUMMARY], "keywords": list(made["keywords"] or [])[:SHOWN_KEYWORDS]}

        return self._answer(make)

    def get_indexing_stats(self) -> dict:
        return self._answer(lambda: {"stats": {k: v for k, v in self._totals().items() if k != "chunk_types"}})

    def _totals(self) -> dict:
        catalog, chunks = self.store.catalog(), self.store.chunks()
        s = statistics(catalog, chunks).first().asDict()
        types = {x["file_type"]: x["n"] for x in value_counts(catalog, "file_type").collect()}
        kinds = {x["element_type"]: x["n"] for x in value_counts(chunks, "element_type").collect()}
        return {"total_documents": s["total_documents"], "total_chunks": s["total_chunks"], "total_size_mb": round(s["file_size"] / 1048576, 2), "total_chars": s["total_chars"], "total_tokens": s["total_tokens"], "file_types": types, "chunk_types": kinds, "db_path": self.store.root}
