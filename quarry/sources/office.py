"""DOCX and XLSX files with the standard library: zip archives of XML."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_PR = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _open(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError(f"not an Office Open XML file: {e}") from e


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _run_text(p: ElementTree.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == _W + "t":
            out.append(e.text or "")
        elif e.tag == _W + "tab":
            out.append("\t")
        elif e.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def _cell_text(cell: ElementTree.Element) -> str:
    return "\n".join(_run_text(p) for p in cell.findall(_W + "p"))


def _table_rows(table: ElementTree.Element) -> list[list[str]]:
    rows = []
    for tr in table.findall(_W + "tr"):
        row = []
        for tc in tr.findall(_W + "tc"):
            span = tc.find(f"{_W}tcPr/{_W}gridSpan")
            row += [_cell_text(tc).strip()] * int(span.get(_W + "val", "1") if span is not None else 1)
        rows.append(row)
    return rows


def docx_blocks(content: bytes) -> list[dict]:
    """The body's blocks in order: kind (paragraph, image, table), style name, text, rows, alt_text, numbered, image.

    A paragraph with pictures is one block an image; the first holds the paragraph's own text, for all of them.
    """
    with _open(content) as z:
        body = _part(z, "word/document.xml")
        body = body.find(_W + "body") if body is not None else None
        if body is None:
            raise ValueError("no document in the file")
        styles = _part(z, "word/styles.xml")
        names = {}
        for s in styles.findall(_W + "style") if styles is not None else []:
            label = s.find(_W + "name")
            names[s.get(_W + "styleId")] = label.get(_W + "val") if label is not None else ""
        relations = _part(z, "word/_rels/document.xml.rels")
        targets = {r.get("Id"): r.get("Target") for r in relations.findall(_PR + "Relationship")} if relations is not None else {}
        out: list[dict] = []
        for e in body:
            if e.tag == _W + "tbl":
                out.append({"kind": "table", "style": "", "text": "", "rows": _table_rows(e), "alt_text": "", "numbered": False, "image": b""})
            elif e.tag == _W + "p":
                props = e.find(_W + "pPr")
                style = props.find(_W + "pStyle") if props is not None else None
                style_name = names.get(style.get(_W + "val"), style.get(_W + "val")) if style is not None else "Normal"
                base = {"style": style_name or "", "text": _run_text(e).strip(), "rows": [], "alt_text": "", "numbered": props is not None and props.find(_W + "numPr") is not None, "image": b""}
                drawings = list(e.iter(_W + "drawing"))
                for d in drawings:
                    label = d.find(f".//{_WP}docPr")
                    alt = ((label.get("descr") or label.get("title") or "") if label is not None else "").strip()
                    for blip in d.iter(_A + "blip"):
                        target = targets.get(blip.get(_R + "embed"))
                        if target is not None:
                            name = f"word/{target}" if not target.startswith("/") else target[1:]
                            image = z.read(name) if name in z.namelist() else b""
                            out.append(base | {"kind": "image", "alt_text": alt, "image": image})
                if not drawings:
                    out.append(base | {"kind": "paragraph"})
        return out


def _markdown(rows: list[list[str]]) -> str:
    """functions.sheets.markdown() without its limits, for one table in a worker."""
    n = max(len(r) for r in rows)
    cells = [[c.replace("|", "\\|").replace("\n", " ") for c in r + [""] * (n - len(r))] for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * n) + " |", *lines[1:]])


_CAPTION = re.compile(r"(?i)(fig(ure)?|chart|diagram|image|plate|exhibit|photo|illustration)\s*[\dA-Za-z.]+\s*[:\-–]")


def _figure_text(alt: str, caption: str, ocr: str, title: str) -> str:
    lines = [f"{n}: {v}" for n, v in (("Description", alt), ("Caption", caption), ("Text in image", ocr)) if v]
    return "\n".join(lines) or f"[Visual element — {title or 'unknown document'}]"


def docx_elements(content: bytes, title: str, ocr=None, least_ocr_bytes: int = 5000) -> list[dict]:
    """The typed elements of a document, with section paths and captions; ocr: bytes -> text, or None.

    An image takes as its caption its paragraph's own text, or the very next paragraph if that has a caption's style or
    wording; that paragraph is then no element.
    """
    out: list[dict] = []
    stack: list[str] = []
    waiting: list[dict] = []

    def caption(text: str) -> None:
        for f in waiting:
            if not f["caption"]:
                f["caption"] = text
                f["text"] = _figure_text(f["alt_text"], text, f["ocr_text"], title)
        waiting.clear()

    def add(kind: str, text: str, **more) -> dict:
        out.append({"element_type": kind, "text": text, "section_path": " > ".join(stack), "page_or_sheet": None, "html_or_markdown": "", "extracted_by": ""} | more)
        return out[-1]

    for b in docx_blocks(content):
        text, style = b["text"], b["style"]
        low = style.lower().strip()
        if b["kind"] == "table":
            waiting.clear()
            if b["rows"]:
                add("table", "\n".join(" | ".join(r) for r in b["rows"]), html_or_markdown=_markdown(b["rows"]))
        elif b["kind"] == "image":
            seen = ocr(b["image"]) if ocr and len(b["image"]) >= least_ocr_bytes else ""
            waiting.append(add("figure", _figure_text(b["alt_text"], "", seen, title), alt_text=b["alt_text"], caption="", ocr_text=seen))
            if text:
                caption(text)
        elif waiting and ("caption" in low or (text and _CAPTION.match(text))):
            caption(text)
        else:
            waiting.clear()
            if not text:
                continue
            heading = re.match(r"heading\s*(\d)", low)
            if low == "title":
                stack = [text]
                add("title", text)
            elif heading:
                level = int(heading[1])
                stack = stack[: level - 1 if level else -1] + [text]
                add(f"heading_{level}", text)
            else:
                add("list_item" if "list" in low or b["numbered"] else "paragraph", text)
    return out


def docx_text(content: bytes) -> str:
    """The paragraphs that aren't blank, then all tables' rows, their cells parted by ' | ' without empty ones."""
    blocks = docx_blocks(content)
    lines = [b["text"] for b in blocks if b["kind"] != "table" and b["text"].strip()]
    for b in blocks:
        lines += [" | ".join(c for c in row if c) for row in b["rows"] if any(row)]
    return "\n".join(lines)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _is_date(code: str) -> bool:
    return bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet in order; cells as text, '' for empty ones, with the values that formulas had."""
    with _open(content) as z:
        book = _part(z, "xl/workbook.xml")
        if book is None:
            raise ValueError("no workbook in the file")
        relations = _part(z, "xl/_rels/workbook.xml.rels")
        targets = {r.get("Id"): r.get("Target") for r in relations.findall(_PR + "Relationship")} if relations is not None else {}
        shared_part = _part(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in shared_part.findall(_S + "si")] if shared_part is not None else []
        styles = _part(z, "xl/styles.xml")
        codes, dates = {}, []
        if styles is not None:
            codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(_S + "numFmt")}
            for xf in styles.findall(f"{_S}cellXfs/{_S}xf"):
                i = int(xf.get("numFmtId", "0"))
                dates.append(14 <= i <= 22 or 45 <= i <= 47 or _is_date(codes.get(i, "")))
        out = []
        for sheet in book.iter(_S + "sheet"):
            target = targets.get(sheet.get(_R + "id"), "")
            part = _part(z, target[1:] if target.startswith("/") else f"xl/{target}")
            rows: list[list[str]] = []
            for row in part.iter(_S + "row") if part is not None else []:
                number = int(row.get("r", len(rows) + 1))
                rows += [[] for _ in range(number - 1 - len(rows))]
                cells: list[str] = []
                for c in row.findall(_S + "c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    cells.append(_cell(c, shared, dates))
                rows.append(cells)
            wide = max((len(r) for r in rows), default=0)
            out.append((sheet.get("name"), [r + [""] * (wide - len(r)) for r in rows]))
        return out


def _cell(c: ElementTree.Element, shared: list[str], dates: list[bool]) -> str:
    kind, value = c.get("t", "n"), c.findtext(_S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(_S + "t"))
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return str(value == "1")
    if kind != "n":
        return value
    style = int(c.get("s", "0"))
    if style < len(dates) and dates[style]:
        return str(datetime(1899, 12, 30) + timedelta(days=float(value)))
    number = float(value)
    return str(int(number)) if number.is_integer() and "." not in value and "e" not in value.lower() else str(number)


def xlsx_text(content: bytes) -> str:
    """Each sheet's name in brackets, then its rows, cells parted by ' | ' without empty ones."""
    lines = []
    for name, rows in xlsx_sheets(content):
        lines.append(f"[Sheet: {name}]")
        lines += [" | ".join(c for c in r if c) for r in rows if any(r)]
    return "\n".join(lines)
