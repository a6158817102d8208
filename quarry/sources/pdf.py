"""PDF files: text and elements of pages, figures, embedded files, pages for a vision model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame

from .pdffile import PdfFile, body_size

#: Fewer characters than this on a page with pictures: the page is a picture.
IMAGE_PAGE_CHARS = 80
LEAST_AREA, MOST_IMAGES = 4000, 8
#: Images of fewer bytes aren't read by OCR; pages that a layout parser gets at once; bytes of a page for a vision model.
LEAST_OCR_BYTES, PAGES_AT_ONCE, MOST_PAGE_BYTES = 5000, 10, 4 << 20


def literal_string(obj: str, key: str) -> str | None:
    """The value of /key (...) in an object's source, with \\( \\) and \\\\ unescaped."""
    at = re.search(rf"/{re.escape(key)}\s*\(", obj)
    if not at:
        return None
    out, i = [], at.end()
    while i < len(obj):
        ch = obj[i]
        if ch == ")":
            return "".join(out)
        if ch == "\\" and i + 1 < len(obj):
            i += 1
            out.append(obj[i] if obj[i] in "()\\" else "\\" + obj[i])
        else:
            out.append(ch)
        i += 1
    return None


def reference(obj: str, key: str) -> int | None:
    """The number of the object that /key n g R refers to."""
    found = re.search(rf"/{re.escape(key)}\s+([0-9]+)\s+[0-9]+\s+R", obj)
    return int(found[1]) if found else None


def is_portfolio(catalog: str) -> bool:
    return "/Collection" in catalog


def safe_name(name: str, index: int) -> str:
    """A file name without characters that file systems refuse."""
    return re.sub(r'[\\/:*?"<>|]', "_", name) or f"embedded_{index}"


def embedded_files(objects: list[str], stream: Callable[[int], bytes]) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of all file specifications among a document's objects; a name that repeats gets its number.

    stream: an object's number -> its decoded bytes.
    """
    used: set[str] = set()
    number = 0
    for obj in objects:
        if "/Type /Filespec" not in obj:
            continue
        name = literal_string(obj, "UF") or literal_string(obj, "F")
        files = re.search(r"/EF\s*<<([^>]+)>>", obj)
        at = reference(files[1], "F") if files else None
        if not name or at is None:
            continue
        safe = safe_name(name, number)
        if safe in used:
            stem, dot, suffix = safe.rpartition(".")
            safe = f"{stem}_{number}.{suffix}" if dot and stem else f"{safe}_{number}"
        used.add(safe)
        number += 1
        yield safe, stream(at)


def page_texts(content: bytes) -> list[str]:
    """The text of each page: by PyMuPDF where that is installed, else by this package's own reader."""
    try:
        import fitz
    except ImportError:
        return ["\n".join(t for t, _ in p["blocks"]) for p in PdfFile(content).pages()]
    with fitz.open(stream=content, filetype="pdf") as doc:
        return [p.get_text() for p in doc]


def flat_text(pages: list[str]) -> str:
    """Pages that aren't blank, each under its number, parted by blank lines."""
    return "\n\n".join(f"[Page {i}]\n{t}" for i, t in enumerate(pages, 1) if t.strip())


def fallback_elements(page: int, blocks: list[str], images: list[dict]) -> list[dict]:
    """The elements of a page that the layout model left out.

    images: {width, height, alt_text, ocr_text}. At most MOST_IMAGES, by place, of at least LEAST_AREA are figures; the
    first caption among the blocks stands for each. A page of pictures with hardly any text and no figure is one.
    """
    from .office import _CAPTION, _figure_text

    section, number = f"Page {page}", str(page)
    base = {"section_path": section, "page_or_sheet": number, "html_or_markdown": "", "extracted_by": "easyocr"}
    texts = [b.strip() for b in blocks if b.strip()]
    caption = next((t for t in texts if _CAPTION.match(t)), "")
    out = []
    for image in images[:MOST_IMAGES]:
        if image["width"] * image["height"] >= LEAST_AREA:
            ocr = image.get("ocr_text", "")
            out.append(base | {"element_type": "figure", "text": _figure_text(image.get("alt_text", ""), caption, ocr, ""), "caption": caption, "ocr_text": ocr, "is_image_page": False})
    picture = bool(images) and sum(map(len, texts)) < IMAGE_PAGE_CHARS
    if picture and not out:
        return [base | {"element_type": "figure", "text": f"[Visual element — page {page}]", "caption": "", "ocr_text": "", "is_image_page": True}]
    return out + [base | {"element_type": "paragraph", "text": t, "is_image_page": picture} for t in texts]


class Ocr(Protocol):
    """Reads the text in an image; '' where there is none."""

    def __call__(self, image: bytes) -> str: ...


class ElementParser(Protocol):
    """A layout model: the typed elements of some pages. Pages that it gives nothing for fall back."""

    def __call__(self, pages: list[dict]) -> list[dict]: ...


def by_size(pages: list[dict]) -> list[dict]:
    """The offline layout parser: blocks larger than the body's are headings, the largest of level 1.

    It leaves pages of pictures to the fallback.
    """
    body, out = body_size(pages), []
    larger = sorted({round(s, 1) for p in pages for t, s in p["blocks"] if s > 1.15 * body and len(t) < 200}, reverse=True)
    path: list[str] = []
    for p in pages:
        if p["images"] and sum(len(t) for t, _ in p["blocks"]) < IMAGE_PAGE_CHARS:
            continue
        for text, size in p["blocks"]:
            level = larger.index(round(size, 1)) + 1 if round(size, 1) in larger and len(text) < 200 else 0
            if level:
                path = [*path[: level - 1], text]
            kind = f"heading_{min(level, 9)}" if level else "list_item" if re.match(r"[•‣▪*–-]\s|[0-9]{1,3}[.)]\s", text) else "paragraph"
            out.append({"element_type": kind, "text": text, "section_path": " > ".join(path), "page_or_sheet": str(p["number"]), "html_or_markdown": "", "extracted_by": "layout"})
    return out


def _read(image: dict, ocr: Ocr | None) -> str:
    if ocr is None or len(image["data"]) < LEAST_OCR_BYTES:
        return ""
    try:
        return ocr(image["data"]) or ""
    except Exception:  # an image may be broken in any way; it then has no text
        return ""


def elements(content: bytes, parser: ElementParser = by_size, ocr: Ocr | None = None) -> list[dict]:
    """The elements of a file by page: those of the layout parser, which gets PAGES_AT_ONCE pages, and for pages that
    it has nothing for, or fails on, those of fallback_elements()."""
    pages, found = PdfFile(content).pages(), []
    for i in range(0, len(pages), PAGES_AT_ONCE):
        try:
            found += parser(pages[i : i + PAGES_AT_ONCE])
        except Exception:  # a layout model may fail in any way; its pages fall back
            continue
    covered = {e["page_or_sheet"] for e in found}
    for p in pages:
        if str(p["number"]) not in covered:
            images = [{"width": x["width"], "height": x["height"], "alt_text": "", "ocr_text": _read(x, ocr)} for x in p["images"]]
            found += fallback_elements(p["number"], [t for t, _ in p["blocks"]], images)
    return sorted(found, key=lambda e: int(e["page_or_sheet"]))


def rendered(page: dict) -> bytes | None:
    """The offline picture of a page: its largest image, if a vision model can take it."""
    best = max((x for x in page["images"] if len(x["data"]) <= MOST_PAGE_BYTES), key=lambda x: x["width"] * x["height"], default=None)
    return best["data"] if best else None


def pages_of(files: DataFrame, keys: list[str], content: str = "content", render: Callable[[dict], bytes | None] = rendered) -> DataFrame:
    """(keys, page, words, width, height, image) of each page; files that can't be read give none."""

    def run(batches):
        import pyarrow as pa

        names = [*keys, "page", "words", "width", "height", "image"]
        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(batch.column(content).to_pylist()):
                try:
                    made = PdfFile(raw or b"").pages()
                except Exception:  # any file may be broken in any way; the parser's row tells
                    continue
                for p in made:
                    at.append(i)
                    rows.append((p["number"], sum(len(t.split()) for t, _ in p["blocks"]), p["width"], p["height"], render(p)))
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary())
            cols = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in keys), *cols], names=names)

    schema = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, content).mapInArrow(run, f"{schema}, page int, words int, width double, height double, image binary")


def described_pages(pages: DataFrame, keys: list[str], describe: Callable[[bytes], str], at_once: int = 5) -> DataFrame:
    """(keys, page, description) of pages with an image, by at most `at_once` calls at a time; a page whose call fails,
    or says nothing, is left out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, said = [], []
            for i, image in enumerate(batch.column("image").to_pylist()):
                try:
                    text = describe(image)
                except Exception:  # a model may fail in any way; the other pages go on
                    continue
                if text and text.strip():
                    at.append(i)
                    said.append(text.strip())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in [*keys, "page"]), pa.array(said, pa.string())], names=[*keys, "page", "description"])

    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.where("image is not null").select(*keys, "page", "image").repartition(at_once).mapInArrow(run, f"{schema}, page int, description string")


def unpacked(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, name, bytes) of the files embedded in PDF portfolios; other files, and broken ones, give none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(batch.column(content).to_pylist()):
                try:
                    made = PdfFile(raw or b"")
                    sources = [made.sources[n] for n in sorted(made.sources)]
                    found = list(embedded_files(sources, made.stream)) if any(is_portfolio(s) for s in sources) else []
                except Exception:  # as above
                    continue
                at += [i] * len(found)
                rows += found
            cols = [pa.array([n for n, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in keys), *cols], names=[*keys, "name", "bytes"])

    schema = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, content).mapInArrow(run, f"{schema}, name string, bytes binary")
