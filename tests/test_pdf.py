import zlib

import pytest
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.operators.store import Store
from quarry.plans.ingest import Indexer
from quarry.sources import pdf
from quarry.sources.pdffile import PdfFile


def made(pages, images=(), extra=(), collection=False, packed=False):
    """A PDF file: pages are contents; images are (page, width, height, bytes); extra are further objects' bytes."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R " + (b"/Collection << >> " if collection else b"") + b">>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    kids, n = [], 4
    for i, content in enumerate(pages):
        data = zlib.compress(content)
        own = [(w, h, b) for p, w, h, b in images if p == i]
        names = []
        for w, h, b in own:
            objects[n] = b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (w, h, len(b), b)
            names.append(b"/I%d %d 0 R" % (n, n))
            n += 1
        objects[n] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(data), data)
        objects[n + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /MediaBox [0 0 %d 792] /Resources << /Font << /F1 3 0 R >> /XObject << %s >> >> >>" % (n, 1000 if own else 612, b" ".join(names))
        kids.append(b"%d 0 R" % (n + 1))
        n += 2
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    for x in extra:
        objects[n] = x
        n += 1
    if packed:
        plain = [k for k, v in objects.items() if b"stream" not in v]
        heads, bodies, at = [], b"", 0
        for k in plain:
            heads.append(b"%d %d" % (k, at))
            bodies += objects[k] + b" "
            at = len(bodies)
            del objects[k]
        head = b" ".join(heads) + b" "
        data = zlib.compress(head + bodies)
        objects[n] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(plain), len(head), len(data), data)
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in sorted(objects.items())) + b"trailer << /Root 1 0 R >>"


TEXT = rb"""BT /F1 24 Tf 72 720 Td (The \(Great\) Title) Tj /F1 11 Tf 0 -60 Td (First line of the body that is long) Tj 0 -13 Td [(sec) 20 (ond) -300 (line)] TJ 0 -60 Td (Another paragraph here.) Tj ET"""
JPEG = b"\xff\xd8" + b"x" * 6000


@pytest.mark.parametrize("packed", [False, True])
def test_pages_and_elements(packed):
    raw = made([TEXT, b"BT /F1 11 Tf 72 700 Td (Figure 1: a chart) Tj ET"], [(1, 300, 200, JPEG), (1, 10, 10, JPEG)], packed=packed)
    first, second = PdfFile(raw).pages()
    assert [t for t, _ in first["blocks"]] == ["The (Great) Title", "First line of the body that is long\nsecond line", "Another paragraph here."]
    assert (second["width"], second["images"][0]["width"], second["images"][0]["data"]) == (1000, 300, JPEG)
    found = pdf.elements(raw, ocr=lambda image: "seen text")
    assert [(e["element_type"], e["page_or_sheet"], e["extracted_by"]) for e in found] == [("heading_1", "1", "layout"), ("paragraph", "1", "layout"), ("paragraph", "1", "layout"), ("figure", "2", "easyocr"), ("paragraph", "2", "easyocr")][: len(found)]
    assert found[1]["section_path"] == "The (Great) Title" and "seen text" in found[3]["text"] and "Figure 1: a chart" in found[3]["text"]
    assert pdf.flat_text(pdf.page_texts(raw)).startswith("[Page 1]\nThe (Great) Title\nFirst line")


def test_a_failing_layout_falls_back_by_batches():
    raw = made([b"BT /F1 11 Tf 72 700 Td (Words of page %d, which are enough to be no picture at all) Tj ET" % i for i in range(1, 24)])

    def some(pages):
        if pages[0]["number"] == 11:
            raise RuntimeError("no memory")
        return [{"element_type": "paragraph", "text": "L", "section_path": "", "page_or_sheet": str(p["number"]), "html_or_markdown": "", "extracted_by": "model"} for p in pages if p["number"] != 3]

    found = pdf.elements(raw, some)
    assert [int(e["page_or_sheet"]) for e in found] == list(range(1, 24))
    assert [e["page_or_sheet"] for e in found if e["extracted_by"] == "easyocr"] == ["3", *map(str, range(11, 21))]


def test_broken_files():
    for raw in (b"", b"This is not a valid PDF", b"%PDF-1.4\n", made([TEXT])[:200], b"%PDF-1.4 1 0 obj << >> endobj trailer << /Encrypt 5 0 R >>"):
        with pytest.raises(ValueError):
            PdfFile(raw).pages()


def test_unicode_map_and_hex_strings():
    cmap = b"2 beginbfchar <0041> <0416> <0042> <D83DDE00> endbfchar 1 beginbfrange <0043> <0045> <0061> endbfrange"
    raw = made([b"BT /F1 11 Tf 72 700 Td <004100420043 0045> Tj ET"]).replace(b"/Subtype /Type1 /BaseFont /Helvetica", b"/Subtype /Type0 /ToUnicode 900 0 R")
    raw = raw.replace(b"trailer", b"900 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\ntrailer" % (len(cmap), cmap))
    assert PdfFile(raw).pages()[0]["blocks"][0][0] == "Ж😀ac"


def test_portfolio_rows(spark):
    embedded = [b"<< /Length 5 >>\nstream\nhello\nendstream", b"<< /Type /Filespec /UF (a.txt) /EF << /F 6 0 R >> >>"]
    raw = made([TEXT], extra=embedded, collection=True)
    df = spark.createDataFrame([("p", raw), ("q", made([TEXT], extra=embedded)), ("r", b"broken")], "file string, content binary")
    assert [(r["file"], r["name"], bytes(r["bytes"])) for r in pdf.unpacked(df, ["file"]).collect()] == [("p", "a.txt", b"hello")]


def test_pages_for_a_vision_model(spark):
    raw = made([TEXT, b"BT /F1 11 Tf 72 700 Td (few) Tj ET", b""], [(1, 300, 200, JPEG), (2, 30, 20, b"bad")])
    pages = pdf.pages_of(spark.createDataFrame([("p", raw), ("r", b"broken")], "file string, content binary"), ["file"])
    assert [(r["page"], r["words"], r["image"] is not None) for r in pages.orderBy("page").collect()] == [(1, 16, False), (2, 1, True), (3, 0, True)]

    def describe(image):
        if image == b"bad":
            raise RuntimeError("refused")
        return " a chart of sales "

    told = pdf.described_pages(pages, ["file"], describe, 2)
    assert told.rdd.getNumPartitions() <= 2 and [(r["file"], r["page"], r["description"]) for r in told.collect()] == [("p", 2, "a chart of sales")]


def test_pdfs_are_indexed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "report.pdf").write_bytes(made([TEXT, b""], [(1, 300, 200, JPEG)]))
    store = Store(spark, f"file://{tmp_path}/store")
    config = Config(enable_vision_enhancement=True, vision_mode="threshold", vision_word_threshold=5)
    ix = Indexer(spark, store, config, ocr=lambda image: "text in the picture", vision=lambda image: "A bar chart.")
    assert ix.index(f"file://{tmp_path}/in") == {"indexed": 1, "deleted": 0, "failed": 0}
    text = " ".join(r["chunk_text"] for r in store.chunks().orderBy("chunk_id").collect())
    assert "second line" in text and "text in the picture" in text and "A bar chart." in text
    assert text.index("text in the picture") < text.index("A bar chart.")
    assert store.chunks().where(F.col("element_type") == "vision_description").count() == 1
