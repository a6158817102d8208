import random
import tracemalloc

import pyarrow as pa
import pytest

from quarry.operators import chunk as c


def test_tail_windows():
    assert len(list(c.char_windows("short text", 2000, 200))) == 10
    assert len(list(c.char_windows("x" * 1000, 2000, 200))) == 201
    assert len(list(c.char_windows("This is a test. " * 50, 100, 20))) == 29
    assert len(list(c.char_windows("x" * 1000, 2000, 200, "stop"))) == 1


def test_breaks():
    assert next(c.char_windows("a" * 55 + "\n\n" + "b" * 100, 100, 10))[1] == 55
    assert next(c.char_windows("a" * 40 + "\n\n" + "b" * 100, 100, 10))[1] == 100  # before the window's middle
    assert next(c.char_windows("a" * 60 + ". " + "b" * 20 + "! " + "c" * 90, 100, 10))[1] == 62  # the first kind, not the last place


@pytest.mark.parametrize("tail", ["reference", "stop"])
def test_windows_cover_the_text(tail):
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("ab.!? \n") for _ in range(r.randrange(1, 400)))
        size, overlap = r.randrange(5, 80), r.randrange(0, 60)
        spans = list(c.char_windows(t, size, overlap, tail))
        covered = {i for a, b in spans for i in range(a, b)}
        assert all(not t[i].strip() for i in set(range(len(t))) - covered)
        assert [a for a, _ in spans] == sorted({a for a, _ in spans})


def test_chunk_text(spark):
    df = spark.createDataFrame([(1, "  one. two  "), (2, ""), (3, None), (4, " \n ")], "doc_id long, text string")
    rows = c.chunk_text(df, 2000, 0, "stop").collect()
    assert [(r["doc_id"], r["chunk_id"], r["text"], r["start_pos"], r["end_pos"], r["char_count"], r["token_count"]) for r in rows] == [(1, 0, "one. two", 0, 12, 8, 3)]


def e(kind, text, **more):
    return {"element_type": kind, "text": text, "section_path": more.pop("section", "S"), "page_or_sheet": more.pop("page", "1"), "html_or_markdown": "", "extracted_by": ""} | more


def words(t):
    return len(t.split())


def test_structured_chunks():
    elements = [
        e("title", "The title"), e("paragraph", "one two three", extracted_by="docling"), e("list_item", "four five", extracted_by="easyocr", page="2"), e("paragraph", " "), e("table", "a | b", html_or_markdown="| a | b |", summary="sum"),
        e("heading_2", "Deep"), e("heading_1", "High"), e("paragraph", "x " * 6, section="High"), e("paragraph", "y " * 6, section="Low"),
    ]
    got = c.structured_chunks(elements, "Doc", 8, words)
    assert [(g["element_type"], g["text"]) for g in got] == [
        ("title", "The title\n\none two three\n\nfour five"), ("table", "a | b"), ("heading_2", "Deep"), ("heading_1", "High\n\n" + "x " * 6), ("paragraph", "y " * 6),
    ]
    assert got[0]["extracted_by"] == "docling,easyocr" and got[0]["page_or_sheet"] == "2" and got[0]["start_pos"] == -1
    assert got[1]["embedding_text"] == "Document: Doc | Section: S | Type: table | Summary: sum | | a | b |"
    assert got[0]["embedding_text"] == "Document: Doc | Section: S | The title\n\none two three\n\nfour five"
    assert [g["chunk_id"] for g in got] == list(range(5))


def test_over_budget():
    long = "One two three. Four five six! Seven eight nine ten eleven twelve thirteen. End."
    got = c.structured_chunks([e("paragraph", long), e("table", "w " * 50)], "", 6, words)
    assert [(g["text"], g["token_count"]) for g in got] == [("One two three. Four five six!", 6), ("Seven eight nine ten eleven twelve thirteen.", 7), ("End.", 1), (("w " * 50).strip(), 50)]


def test_chunk_elements(spark):
    kind = "array<struct<element_type:string,text:string,section_path:string,page_or_sheet:string,html_or_markdown:string,extracted_by:string>>"
    df = spark.createDataFrame([("p", "T", [("heading_1", "H", "H", None, "", ""), ("paragraph", "body", "H", None, "", None)]), ("q", "T", []), ("r", None, None)], f"file_path string, title string, elements {kind}")
    rows = c.chunk_elements(df).collect()
    assert [(r["file_path"], r["text"], r["element_type"], r["page_or_sheet"]) for r in rows] == [("p", "H\n\nbody", "heading_1", "")]


def test_stop_runs_to_the_end_of_a_long_text():
    t = "x" * 30_000
    spans = list(c.char_windows(t, 2, 0, "stop"))
    assert len(spans) == 15_000 > c.MOST_CHUNKS and spans[-1] == (29_998, 30_000)
    assert len(list(c.char_windows(t, 2, 0))) == c.MOST_CHUNKS


@pytest.mark.parametrize("tail", ["reference", "stop"])
def test_chunks_leave_a_task_in_parts(spark, monkeypatch, tail):
    df, held = spark.createDataFrame([], "doc_id long, text string"), []
    plain_map = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: held.append(f) or plain_map(self, f, *a, **b))
    c.chunk_text(df, 500, 100, tail)
    n = 600 if tail == "reference" else 6000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None, "", *("word and more. " * 300 for _ in range(n - 2))])], names=["doc_id", "text"])
    rows, seen = 0, []
    tracemalloc.start()
    for part in held[0](iter([batch])):
        rows += part.num_rows
        seen += dict.fromkeys(part.column(0).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    assert rows == (n - 2) * len(list(c.char_windows("word and more. " * 300, 500, 100, tail))) and sorted(set(seen)) == list(range(2, n))
