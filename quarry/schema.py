"""Schemas of the engine's tables and of what passes between its stages, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row a document. Keywords are a native array; functions.text has their JSON form for the edges.
CATALOG = (
    "file_path string, file_name string, file_hash string, file_size bigint, file_type string, modified_time string, indexed_time string, "
    "summary string, keywords array<string>, total_chunks bigint, total_chars bigint, total_tokens bigint, embedding array<float>"
)

#: One row a chunk; (file_path, chunk_id) is the key. Positions are -1 where a chunk is no stretch of the text.
CHUNKS = (
    "file_path string, file_hash string, chunk_id bigint, chunk_text string, start_pos bigint, end_pos bigint, char_count bigint, token_count bigint, "
    "element_type string, section_path string, page_or_sheet string, embedding_text string, html_or_markdown string, extracted_by string, embedding array<float>"
)

#: The columns of chunks that came after the first version of the table; older tables get them empty.
STRUCTURED = ("element_type", "section_path", "page_or_sheet", "embedding_text", "html_or_markdown", "extracted_by")

#: A typed block of a document; its place in the array is its place in the document.
ELEMENT = (
    "element_type string, text string, section_path string, page_or_sheet string, html_or_markdown string, extracted_by string, "
    "summary string, source_range string, caption string, alt_text string, ocr_text string, is_image_page boolean"
)

CHUNK = (
    "chunk_id int, text string, start_pos int, end_pos int, char_count int, token_count int, element_type string, section_path string, "
    "page_or_sheet string, embedding_text string, html_or_markdown string, extracted_by string"
)

EVENT = "ts timestamp, kind string, path string, dest string"

ELEMENT_TYPES = ("title", *(f"heading_{i}" for i in range(1, 10)), "paragraph", "list_item", "table", "sheet", "figure", "cell_range", "vision_description")


def with_structured_columns(chunks: DataFrame) -> DataFrame:
    """Chunks with all structured columns: those that are missing or null are empty."""
    return chunks.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in chunks.columns else F.lit("") for c in STRUCTURED})
