"""Folds over the ordered elements of a document, as aggregate() expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import embedding_text, figure_text, heading_level, is_caption, let, or_else, strip

PART_CHARS = 800


def breadcrumbs(styles: Column, texts: Column) -> Column:
    """For each block the path of titles that it lies under, parted by ' > '; it counts itself if it is a heading.

    A title starts the path anew; a heading of level n replaces what lies deeper than n - 1.
    """
    path = "array<string>"

    def step(acc: Column, x: Column) -> Column:
        level, text = heading_level(x["style"]), x["text"]
        stack = F.when(level == 0, F.array(text)).when(level > 0, F.concat(F.slice(acc["stack"], F.lit(1), F.greatest(level - 1, F.lit(0))), F.array(text))).otherwise(acc["stack"])
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.array_join(stack, " > "))).alias("out"))

    start = F.struct(F.array().cast(path).alias("stack"), F.array().cast(path).alias("out"))
    pairs = F.arrays_zip(styles.alias("style"), texts.alias("text"))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def attach_captions(blocks: Column, document_title: Column) -> Column:
    """Elements of blocks (kind, style, text, alt_text, ocr_text, section_path), kind in image, table, paragraph.

    An image waits for a caption: its own text, or that of the very next paragraph if it has a caption's style or
    wording, which is then no element itself. All images that wait get it, unless they have one. Tables and any other
    paragraph, even an empty one, end the waiting. Returns (kind, text, caption, embedding_text) of what stays.
    """
    item = "struct<kind:string,style:string,text:string,caption:string,alt_text:string,ocr_text:string,section_path:string,waits:boolean>"

    def settle(out: Column, caption: Column | None) -> Column:
        def done(x: Column) -> Column:
            named = x["caption"] if caption is None else F.when(x["waits"] & (x["caption"] == ""), caption).otherwise(x["caption"])
            return x.withField("caption", named).withField("waits", F.lit(False))

        return F.transform(out, done)

    def step(acc: Column, b: Column) -> Column:
        text = strip(b["text"])
        waiting = F.exists(acc, lambda x: x["waits"])
        own = F.struct(b["kind"].alias("kind"), b["style"].alias("style"), text.alias("text"), F.lit("").alias("caption"), b["alt_text"].alias("alt_text"), b["ocr_text"].alias("ocr_text"), b["section_path"].alias("section_path"), (b["kind"] == "image").alias("waits"))
        with_own = F.concat(acc, F.array(own))
        captioned = F.when(text != "", settle(with_own, text)).otherwise(with_own)
        is_cap = F.lower(b["style"]).contains("caption") | ((text != "") & is_caption(text))
        other = F.when(text == "", settle(acc, None)).otherwise(F.concat(settle(acc, None), F.array(own)))
        return F.when(b["kind"] == "image", captioned).when(b["kind"] == "table", F.concat(settle(acc, None), F.array(own))).when(is_cap & waiting, settle(acc, text)).otherwise(other)

    clean = F.transform(blocks, lambda b: b.withField("style", F.coalesce(b["style"], F.lit(""))).withField("text", F.coalesce(b["text"], F.lit(""))))
    folded = F.aggregate(clean, F.array().cast(f"array<{item}>"), step)

    def element(x: Column) -> Column:
        figure = x["kind"] == "image"
        text = F.when(figure, figure_text(F.lit(""), x["alt_text"], x["caption"], x["ocr_text"], document_title)).otherwise(x["text"])
        part = lambda name, c: F.concat(F.lit(name), F.nullif(c, F.lit("")))
        rich = F.concat_ws(" | ", part("Document: ", document_title), part("Section: ", x["section_path"]), F.lit("Type: figure"), part("Alt: ", x["alt_text"]), part("Caption: ", x["caption"]), part("OCR: ", F.left(x["ocr_text"], F.lit(600))))
        plain = embedding_text(document_title, x["section_path"], x["text"])
        return F.struct(F.when(figure, "figure").otherwise(x["kind"]).alias("kind"), text.alias("text"), x["caption"].alias("caption"), F.when(figure, rich).otherwise(plain).alias("embedding_text"))

    return F.transform(folded, element)


def split_description(text: Column, page: Column, most: int = PART_CHARS) -> Column:
    """A vision model's description of a page as elements (text, section_path, page_or_sheet).

    One that is longer than `most` is packed from whole paragraphs, and each part names its number.
    """
    number = page.cast("string")
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last, F.lit("\n\n"), p)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))
        return F.when(F.size(acc) == 0, F.array(p)).when(F.length(joined) > most, F.concat(acc, F.array(p))).otherwise(grown)

    parts = F.aggregate(paragraphs, F.array().cast("array<string>"), step)

    def elements(parts: Column) -> Column:
        def element(p: Column, i: Column) -> Column:
            place = F.concat(F.lit("part "), (i + 1).cast("string"), F.lit(" of "), F.size(parts).cast("string"))
            return F.struct(
                F.concat(F.lit("[Vision description of slide "), number, F.lit(", "), place, F.lit("]: "), p).alias("text"),
                F.concat(F.lit("Page "), number, F.lit(" ("), place, F.lit(")")).alias("section_path"), number.alias("page_or_sheet"),
            )

        return F.transform(parts, element)

    whole = F.array(F.struct(F.concat(F.lit("[Vision description of slide "), number, F.lit("]: "), text).alias("text"), F.concat(F.lit("Page "), number).alias("section_path"), number.alias("page_or_sheet")))
    return F.when(F.length(text) <= most, whole).otherwise(let(parts, elements))


def leading_edge(events: Column, gap: float, at: Callable[[Column], Column] = lambda e: e) -> Column:
    """Of events sorted by time those that pass a debounce: the first, and each at least `gap` after the last that passed.

    at: an event -> its time, as a number.
    """

    def step(acc: Column, e: Column) -> Column:
        passes = (F.size(acc) == 0) | (at(e) - at(F.element_at(acc, -1)) >= gap)
        return F.when(passes, F.concat(acc, F.array(e))).otherwise(acc)

    return F.aggregate(events, F.slice(events, 1, 0), step)


def joined_sources(sources: Column) -> Column:
    """Distinct extractors in the order of their first place, joined by commas; empty ones don't count."""
    return F.array_join(F.array_distinct(F.filter(sources, lambda x: F.coalesce(x, F.lit("")) != "")), ",")


def input_text(embedding: Column, summary: Column, first_chunk: Column) -> Column:
    """What a document is embedded by."""
    return or_else(embedding, summary, first_chunk)
