"""Chunkers. Both are sequential within a document and parallel across documents, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import EMBEDDED_CHARS
from .enrich import Tokenizer, WordTokenizer

MOST_CHUNKS = 10_001
#: Chunks, and characters in them, that a task hands on at once.
OUT_ROWS, OUT_CHARS = 4096, 4_000_000
#: Where a window may end, best first: before a blank line, else after one of these.
_BREAKS = (". ", "! ", "? ", "\n")
STANDALONE = frozenset(("table", "sheet", "figure", "cell_range", "vision_description"))
_HEADING = re.compile(r"heading_\d\Z|title\Z")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_CHUNK = [(n, pa.int32() if n in ("chunk_id", "start_pos", "end_pos", "char_count", "token_count") else pa.string()) for n in ("chunk_id", "text", "start_pos", "end_pos", "char_count", "token_count", "element_type", "section_path", "page_or_sheet", "embedding_text", "html_or_markdown", "extracted_by")]


def char_windows(text: str, size: int, overlap: int, tail: str = "reference") -> Iterator[tuple[int, int]]:
    """The (start, end) of each window that isn't blank.

    tail "reference" goes on to the last character in ever shorter windows, as a window starts at most `overlap` before
    the end of the one before, and one further at least, and ends with MOST_CHUNKS windows, as the reference does; "stop"
    ends with the first window that reaches the text's end, however many they are.
    """
    n, start, count = len(text), 0, 0
    while start < n and (tail == "stop" or count < MOST_CHUNKS):
        end = min(start + size, n)
        if end < n:
            low = start + max(size // 2, 1)
            at = text.rfind("\n\n", low, end)
            if at >= 0:
                end = at
            else:
                for mark in _BREAKS:
                    at = text.rfind(mark, low, end)
                    if at >= 0:
                        end = at + len(mark)
                        break
        if text[start:end].strip():
            yield start, end
            count += 1
        if tail == "stop" and end >= n:
            return
        start = max(end - overlap, start + 1)


def _map_texts(docs: DataFrame, keys: list[str], value: str, work: Callable[[object], Iterable[dict]], fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """keys and fields, one row for each that work gives for a row's value. A task holds OUT_ROWS of them, or OUT_CHARS."""
    made = ", ".join(f"{n} {'int' if pa.types.is_int32(t) else 'string'}" for n, t in fields)
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys) + f", {made}"

    def taken(batch: pa.RecordBatch, held: list[tuple[int, dict]]) -> pa.RecordBatch:
        at = pa.array([i for i, _ in held], pa.int32())
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *(pa.array([r[n] for _, r in held], t) for n, t in fields)], names=[*keys, *(n for n, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, chars = [], 0
            for i, v in enumerate(batch.column(value)):
                for row in work(v.as_py()) if v.is_valid else ():
                    held.append((i, row))
                    chars += sum(len(x) for x in row.values() if isinstance(x, str))
                    if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
                        yield taken(batch, held)
                        held, chars = [], 0
            if held:
                yield taken(batch, held)

    return docs.select(*dict.fromkeys([*keys, value])).mapInArrow(run, schema)


def chunk_text(docs: DataFrame, size: int = 2000, overlap: int = 200, tail: str = "reference", key: str = "doc_id", text: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """(key, chunk_id, text, start_pos, end_pos, char_count, token_count), one row a chunk.

    Positions are those before white space is stripped from the chunk's ends, char_count is after. chunk_id counts a
    document's chunks from 0. A null or blank text has none.
    """
    if size < 1 or overlap < 0 or tail not in ("reference", "stop"):
        raise ValueError("size must be positive, overlap not negative, tail reference or stop")
    count = tokenizer or WordTokenizer()

    def work(t: str) -> Iterator[dict]:
        for i, (a, b) in enumerate(char_windows(t, size, overlap, tail)):
            piece = t[a:b].strip()
            yield {"chunk_id": i, "text": piece, "start_pos": a, "end_pos": b, "char_count": len(piece), "token_count": count.count(piece)}

    return _map_texts(docs, [key], text, work, _CHUNK[:6])


def surroundings(title: str, section: str, text: str, kind: str = "", extra: str = "") -> str:
    parts = [f"{n}: {v}" for n, v in (("Document", title), ("Section", section), ("Type", kind)) if v]
    return " | ".join([*parts, *([extra] if extra else []), text[:EMBEDDED_CHARS]])


def split_sentences(text: str, most: int, count: Callable[[str], int]) -> list[tuple[str, int]]:
    """Parts of whole sentences within a budget, with the sum of their sentences' tokens; a longer sentence stands alone."""
    parts: list[tuple[list[str], int]] = []
    for s in _SENTENCE.split(text):
        n = count(s)
        if parts and parts[-1][1] + n <= most:
            parts[-1] = ([*parts[-1][0], s], parts[-1][1] + n)
        else:
            parts.append(([s], n))
    return [(" ".join(p), n) for p, n in parts]


def structured_chunks(elements: list[dict], title: str, most: int, count: Callable[[str], int]) -> list[dict]:
    """The chunks of one document's elements."""
    out: list[dict] = []
    held: list[dict] = []
    tokens = 0

    def add(text: str, n: int, kind: str, section: str, page: str, embedding: str, markdown: str, source: str) -> None:
        out.append({"chunk_id": len(out), "text": text, "start_pos": -1, "end_pos": -1, "char_count": len(text), "token_count": n, "element_type": kind, "section_path": section, "page_or_sheet": page, "embedding_text": embedding, "html_or_markdown": markdown, "extracted_by": source})

    def flush() -> None:
        nonlocal held, tokens
        if not held:
            return
        kinds = [e["element_type"] or "paragraph" for e in held]
        heads = sorted(k for k in kinds if _HEADING.match(k))
        kind = heads[0] if heads else ("list_item" if "list_item" in kinds else "paragraph")
        section, page = held[-1].get("section_path") or "", held[-1].get("page_or_sheet") or ""
        source = ",".join(dict.fromkeys(e["extracted_by"] for e in held if e.get("extracted_by")))
        text = "\n\n".join(e["text"] for e in held)
        n = count(text)
        for part, m in [(text, n)] if n <= most else split_sentences(text, most, count):
            add(part, m, kind, section, page, surroundings(title, section, part), "", source)
        held, tokens = [], 0

    for e in elements:
        text, kind = (e.get("text") or "").strip(), e.get("element_type") or "paragraph"
        if not text:
            continue
        n = count(text)
        if kind in STANDALONE:
            flush()
            section, markdown, summary = e.get("section_path") or "", e.get("html_or_markdown") or "", e.get("summary") or ""
            rich = surroundings(title, section, markdown or text, kind, f"Summary: {summary}" if summary else "")
            add(text, n, kind, section, e.get("page_or_sheet") or "", rich, markdown, e.get("extracted_by") or "")
        elif _HEADING.match(kind):
            flush()
            held, tokens = [e], n
        else:
            if held and tokens + n > most:
                flush()
            held.append(e)
            tokens += n
    flush()
    return out


def chunk_elements(docs: DataFrame, most: int = 512, key: str = "file_path", title: str = "title", elements: str = "elements", tokenizer: Tokenizer | None = None) -> DataFrame:
    """The chunks (as schema.CHUNK) of documents (key, title, elements), elements an array in document order.

    Tables, sheets, figures and descriptions are chunks of their own, never split. A heading begins a chunk. Text fills a
    chunk up to `most` tokens; one that is over it when its parts are joined is split at sentences.
    """
    count = (tokenizer or WordTokenizer()).count
    packed = docs.select(key, F.struct(F.col(title).alias("title"), F.col(elements).alias("elements")).alias("doc"))
    return _map_texts(packed, [key], "doc", lambda d: structured_chunks(d["elements"] or [], d["title"] or "", most, count), _CHUNK)
