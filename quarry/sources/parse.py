"""From file rows to documents: text, elements, and which way each was parsed."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sheets import sheet_element
from . import office, pdf
from .files import decoded, suffix_of

STRUCTURED = (".docx", ".xlsx", ".pdf", ".doc", ".xls")
_ELEMENT = pa.struct([(n, pa.string()) for n in ("element_type", "text", "section_path", "page_or_sheet", "html_or_markdown", "extracted_by", "summary", "caption", "alt_text", "ocr_text")])
_SHEETS = pa.list_(pa.struct([("name", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))]))


def _parsed(name: str, suffix: str, content: bytes, structured: bool, ocr: pdf.Ocr | None = None, layout: pdf.ElementParser = pdf.by_size) -> dict:
    """{elements, sheets, text, error} of one office file: a failure of the structured way leads to the flat one."""
    out: dict = {"elements": [], "sheets": [], "text": None, "error": None}
    title = os.path.splitext(name)[0]
    try:
        if structured and suffix in (".docx", ".doc"):
            out["elements"] = office.docx_elements(content, title, ocr)
        elif structured and suffix in (".xlsx", ".xls"):
            out["sheets"] = [{"name": n, "rows": r} for n, r in office.xlsx_sheets(content) if any(c.strip() for row in r for c in row)]
        elif structured and suffix == ".pdf":
            out["elements"] = pdf.elements(content, layout, ocr)
    except Exception as e:  # any file may be broken in any way; it is reported in its row
        out["error"] = str(e)
    if out["elements"] or out["sheets"]:
        return out
    try:
        if suffix in (".docx", ".doc"):
            out["text"] = office.docx_text(content)
        elif suffix in (".xlsx", ".xls"):
            out["text"] = office.xlsx_text(content)
        else:
            out["text"] = pdf.flat_text(pdf.page_texts(content))
        out["error"] = None
    except Exception as e:  # as above
        out["error"] = str(e)
    return out


def parse(files: DataFrame, structured: bool = True, ocr: pdf.Ocr | None = None, layout: pdf.ElementParser = pdf.by_size) -> DataFrame:
    """files (file_path, file_name, content, ...) with title, elements, text, error.

    Office and PDF files become elements (ocr reads images, layout is the model for pages of PDFs), or flat text where that fails or is empty; a sheet is one element. All others are
    text. error tells why a file has neither; text of a structured document is its elements' texts, parted by blank lines.
    """
    keys = [c for c in files.columns if c != "content"]
    names = [f.name for f in _ELEMENT]
    element = ", ".join(f"{n}:string" for n in names)
    nothing = {"elements": [], "sheets": [], "text": None, "error": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file_name", "_suffix", "content")), strict=True))
            made = [_parsed(n, s, c or b"", structured, ocr, layout) if s in STRUCTURED else nothing for n, s, c in rows]
            raw = pa.array([None if s in STRUCTURED else c or b"" for _, s, c in rows], pa.binary())
            cols = [pa.array([m[k] for m in made], t) for k, t in (("elements", pa.list_(_ELEMENT)), ("sheets", _SHEETS), ("text", pa.string()), ("error", pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *cols, raw], names=[*keys, "elements", "sheets", "text", "error", "_raw"])

    # One pass over all files, as each branch of a union would read every file's contents again.
    schema = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    kinds = f"elements array<struct<{element}>>, sheets array<struct<name:string,rows:array<array<string>>>>, text string, error string, _raw binary"
    rows = files.withColumn("_suffix", suffix_of(F.col("file_name"))).mapInArrow(run, f"{schema}, {kinds}")
    made = F.transform("sheets", lambda s: sheet_element(s["name"], s["rows"]))
    as_elements = F.transform(F.filter(made, lambda e: e.isNotNull()), lambda e: F.struct(*(e[n].alias(n) if n in ("element_type", "text", "section_path", "page_or_sheet", "html_or_markdown", "summary") else F.lit("").alias(n) for n in names)))
    every = F.when(F.size("sheets") > 0, as_elements).otherwise(F.col("elements"))
    joined = F.when(F.size("elements") > 0, F.array_join(F.transform("elements", lambda e: e["text"]), "\n\n")).when(F.col("_raw").isNotNull(), decoded(F.col("_raw"))).otherwise(F.col("text"))
    title = F.regexp_replace("file_name", r"\.[^.]+\z", "")
    return rows.withColumn("elements", every).select(*keys, title.alias("title"), "elements", joined.alias("text"), "error")
