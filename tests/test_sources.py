import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.sources import files, office, parse, pdf

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def para(text="", style=None, numbered=False, image=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if numbered else "")
    draw = f'<w:r><w:drawing><wp:docPr descr="{image}"/><a:blip r:embed="i1"/></w:drawing></w:r>' if image is not None else ""
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r>{draw}</w:p>"


def table(rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


@pytest.fixture(scope="module")
def docx():
    body = [
        para("Doc", "T"), para("Intro", "H1"), para("text one"), para("item", numbered=True), para("Deep", "H3"), table([["a|b", "c"], ["d", ""]]),
        para(image="A cat"), para("Figure 1: the cat"), para(image="dog"), table([["x"]]), para("Figure 2: lost"), para(""), para("end", "L"),
    ]
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("T", "Title"), ("H1", "heading 1"), ("H3", "Heading 3"), ("L", "List Bullet")))
    return zipped({
        "word/document.xml": f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>",
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{REL}"><Relationship Id="i1" Target="media/i.png"/></Relationships>', "word/media/i.png": "png",
    })


@pytest.fixture(scope="module")
def xlsx():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = '<c r="{}" t="{}" s="{}"><v>{}</v></c>'
    rows = f'<row r="1">{cell.format("A1", "s", 0, 0)}{cell.format("C1", "s", 0, 1)}</row><row r="3">{cell.format("A3", "n", 0, "12")}{cell.format("B3", "n", 0, "1.50")}{cell.format("C3", "b", 0, 1)}{cell.format("D3", "n", 1, "45292")}</row>'
    return zipped({
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/><sheet name="Blank" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{REL}"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>Name</t></si><si><r><t>Si</t></r><r><t>ze</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{s}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/a.xml": f'<worksheet xmlns="{s}"><sheetData>{rows}</sheetData></worksheet>', "xl/worksheets/b.xml": f'<worksheet xmlns="{s}"><sheetData/></worksheet>',
    })


def test_docx_elements(docx):
    got = [(e["element_type"], e["text"], e["section_path"]) for e in office.docx_elements(docx, "stem")]
    assert got == [
        ("title", "Doc", "Doc"), ("heading_1", "Intro", "Intro"), ("paragraph", "text one", "Intro"), ("list_item", "item", "Intro"), ("heading_3", "Deep", "Intro > Deep"), ("table", "a|b | c\nd | ", "Intro > Deep"),
        ("figure", "Description: A cat\nCaption: Figure 1: the cat", "Intro > Deep"), ("figure", "Description: dog", "Intro > Deep"), ("table", "x", "Intro > Deep"), ("paragraph", "Figure 2: lost", "Intro > Deep"), ("list_item", "end", "Intro > Deep"),
    ]
    assert office.docx_elements(docx, "s")[5]["html_or_markdown"] == "| a\\|b | c |\n| --- | --- |\n| d |  |"
    assert office.docx_text(docx).splitlines()[-3:] == ["a|b | c", "d", "x"]
    seen = office.docx_elements(docx, "s", ocr=lambda b: b.decode(), least_ocr_bytes=1)
    assert "Text in image: png" in seen[6]["text"]
    with pytest.raises(ValueError):
        office.docx_blocks(b"not a zip")


def test_xlsx(xlsx):
    assert office.xlsx_sheets(xlsx) == [("One", [["Name", "", "Size", ""], ["", "", "", ""], ["12", "1.5", "True", "2024-01-01 00:00:00"]]), ("Blank", [])]
    assert office.xlsx_text(xlsx) == "[Sheet: One]\nName | Size\n12 | 1.5 | True | 2024-01-01 00:00:00\n[Sheet: Blank]"


def test_parse(spark, tmp_path, docx, xlsx):
    contents = {"a.docx": docx, "b.xlsx": xlsx, "c.txt": b"one\r\ntwo\r", "d.pdf": b"This is not a valid PDF", "e.docx": b"bad", "_f.md": "café".encode("latin-1"), "g.html": b"<b>raw</b>"}
    for n, c in contents.items():
        (tmp_path / n).write_bytes(c)
    df = files.metadata(spark.createDataFrame([(f"{tmp_path}/{n}", bytearray(c), len(c)) for n, c in contents.items()], "path string, content binary, length long").withColumn("modificationTime", F.timestamp_seconds(F.lit(0))))
    got = {r["file_name"]: r for r in parse.parse(df).collect()}
    assert [e["element_type"] for e in got["a.docx"]["elements"]][:2] == ["title", "heading_1"] and got["a.docx"]["title"] == "a"
    assert got["b.xlsx"]["elements"][0]["html_or_markdown"].startswith("| Name |") and len(got["b.xlsx"]["elements"]) == 1
    assert got["c.txt"]["text"] == "one\ntwo\n" and got["_f.md"]["text"] == "café" and got["g.html"]["text"] == "<b>raw</b>"
    assert got["d.pdf"]["error"] and got["e.docx"]["error"] and got["c.txt"]["error"] is None
    flat = {r["file_name"]: r for r in parse.parse(df, structured=False).collect()}
    assert flat["a.docx"]["text"].startswith("Doc\nIntro") and flat["a.docx"]["elements"] == []


def test_listing_and_predicate(spark, tmp_path):
    for n in ("a.txt", "b.TXT", "_c.txt", ".d.txt", "~e.txt", "._f.txt", "it's.txt", "g.bin", ".git/h.txt", "sub/i.txt"):
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    # A folder with a dot in the path above hides nothing only if no part begins with one.
    got = [os.path.basename(r["path"]) for r in files.listing(spark, [str(tmp_path)], (".txt",)).collect()]
    assert got == ["_c.txt", "a.txt", "it's.txt", "i.txt"]
    scanned = {os.path.basename(r["path"]) for r in files.scan(spark, f"file://{tmp_path}", (".txt",), contents=False).collect()}
    assert {"a.txt", "b.TXT", "i.txt"} <= scanned and not scanned & {".d.txt", "~e.txt", "g.bin", "h.txt"}
    assert files.file_info(str(tmp_path / "none")) is None and files.file_info(str(tmp_path / "b.TXT"))["extension"] == ".txt"


def test_pdf_helpers():
    obj = r"<< /Type /Filespec /F (old.txt) /UF (a \(1\) \\ b.txt) /EF << /F 12 0 R >> >>"
    assert pdf.literal_string(obj, "UF") == "a (1) \\ b.txt" and pdf.literal_string(obj, "X") is None and pdf.reference(obj, "F") == 12
    twin = r"<< /Type /Filespec /F (a/b.txt) /EF << /F 3 0 R >> >>"
    got = list(pdf.embedded_files([obj, twin, twin, "<< /Type /Page >>", "<< /Type /Filespec /F (x) >>"], lambda n: bytes([n])))
    assert got == [("a (1) _ b.txt", b"\x0c"), ("a_b.txt", b"\x03"), ("a_b_2.txt", b"\x03")]
    assert pdf.is_portfolio("<< /Collection 3 0 R >>") and pdf.flat_text(["one", " ", "two"]) == "[Page 1]\none\n\n[Page 3]\ntwo"


def test_fallback_page():
    big, small = {"width": 100, "height": 100}, {"width": 10, "height": 10}
    assert [e["element_type"] for e in pdf.fallback_elements(1, ["x" * 100], [small])] == ["paragraph"]
    assert pdf.fallback_elements(1, ["few"], [small]) == [{"section_path": "Page 1", "page_or_sheet": "1", "html_or_markdown": "", "extracted_by": "easyocr", "element_type": "figure", "text": "[Visual element — page 1]", "caption": "", "ocr_text": "", "is_image_page": True}]
    two = pdf.fallback_elements(2, ["Figure 1: c", "y" * 90], [big, big])
    assert [e["caption"] for e in two[:2]] == ["Figure 1: c"] * 2 and len(two) == 4


def test_config():
    c = Config.from_env({"WATCH_FOLDERS": "/tmp, /none-such", "CHUNK_SIZE": "500", "ENABLE_OCR": "No", "USE_STRUCTURED_PARSING": "yes", "VISION_MODE": "odd", "FILE_EXTENSIONS": ".a,.B"})
    assert c.watch_folders == ("/tmp",) and c.chunk_size == 500 and not c.enable_ocr and c.use_structured_parsing and c.vision_mode == "threshold" and c.file_extensions == (".a", ".B")
    assert Config.from_env({}) == Config()
