"""Text expressions: all but keywords() are native columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
STOP_WORDS = frozenset(
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would could "
    "should may might must can this that these those i you he she it we they".split()
)
SUMMARY_CHARS = 500
KEYWORDS = 10
EMBEDDED_CHARS = 2000
_SPACES = r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, _SPACES, "")


def or_else(*choices: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices), F.lit(""))


def fallback_summary(text: Column, most: int = SUMMARY_CHARS) -> Column:
    """Whole sentences from the start of a text, parted by '. ', as long as each one's end lies before `most`.

    The separator follows the last sentence too. A text whose first sentence is too long is cut at `most`.
    """
    head = F.left(text, F.lit(most + 1))
    whole = F.regexp_extract(head, r"(?s)\A(.*)\. ", 1)
    cut = F.when(head.rlike(r"\. "), F.concat(whole, F.lit(". "))).otherwise(F.left(text, F.lit(most)))
    return strip(F.when(F.length(text) < most, F.concat(text, F.lit(". "))).otherwise(cut))


def _keywords(text: str, most: int) -> list[str]:
    found = Counter(w for w in re.findall(r"\b[a-z]+\b", text.lower()) if len(w) > 3 and w not in STOP_WORDS)
    return [w for w, _ in found.most_common(most)]


def keywords(text: Column, most: int = KEYWORDS) -> Column:
    """The most frequent words of a text, ties in the order of their first place.

    An Arrow function: natively this takes a shuffle of every word of the corpus.
    """

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _keywords(t, most) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)


def document_embedding_text(summary: Column, words: Column) -> Column:
    return F.concat(summary, F.lit(" Keywords: "), F.array_join(words, ", "))


def described(text: Column) -> Column:
    """(summary, keywords, embedding_text) of a document; an empty one is called so."""
    empty = F.coalesce(text, F.lit("")) == ""
    summary, words = fallback_summary(text), keywords(text)
    nothing = F.array().cast("array<string>")
    return F.struct(
        F.when(empty, F.lit("Empty document")).otherwise(summary).alias("summary"),
        F.when(empty, nothing).otherwise(words).alias("keywords"),
        F.when(empty, F.lit("")).otherwise(document_embedding_text(summary, words)).alias("embedding_text"),
    )


def embedding_text(title: Column, section: Column, text: Column, kind: Column | None = None, extra: Column | None = None) -> Column:
    """What is embedded for a chunk: its surroundings, then the first characters of its text."""
    part = lambda label, c: F.concat(F.lit(label), F.nullif(c, F.lit("")))
    parts = [part("Document: ", title), part("Section: ", section)]
    parts += [part("Type: ", kind)] if kind is not None else []
    parts += [F.nullif(extra, F.lit(""))] if extra is not None else []
    return F.concat_ws(" | ", *parts, F.left(text, F.lit(EMBEDDED_CHARS)))


def figure_text(label: Column, alt: Column, caption: Column, ocr: Column, title: Column) -> Column:
    """The lines that stand for a picture."""
    part = lambda name, c: F.concat(F.lit(name), F.nullif(c, F.lit("")))
    lines = F.concat_ws("\n", F.nullif(label, F.lit("")), part("Description: ", alt), part("Caption: ", caption), part("Text in image: ", ocr))
    return or_else(lines, F.concat(F.lit("[Visual element — "), or_else(title, F.lit("unknown document")), F.lit("]")))


def sentences(text: Column) -> Column:
    """Parted by white space after . ! or ?"""
    return F.split(text, r"(?U)(?<=[.!?])\s+")


_CAPTION = r"(?iU)^(fig(ure)?|chart|diagram|image|plate|exhibit|photo|illustration)\s*[\dA-Za-z.]+\s*[:\-–]"


def is_caption(text: Column) -> Column:
    return strip(text).rlike(_CAPTION)


def heading_level(style: Column) -> Column:
    """0 for a title, 1 to 9 for a heading, else null."""
    name = strip(F.lower(style))
    digit = F.regexp_extract(name, r"(?U)\Aheading\s*(\d)", 1)
    return F.when(name == "title", 0).when(digit != "", digit.cast("int"))


def is_heading(kind: Column) -> Column:
    return kind.rlike(r"^(heading_\d|title)\z")


def page_number(page: Column) -> Column:
    """The number of a page, 0 where it has none; what elements are sorted by."""
    return F.coalesce(strip(page).try_cast("int"), F.lit(0))


def word_count(text: Column) -> Column:
    clean = strip(F.coalesce(text, F.lit("")))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, r"(?U)\s+")))


def wants_vision(mode: str, words: Column, width: Column, height: Column, threshold: int = 50) -> Column:
    """Whether a page is sent to the vision model."""
    if mode == "all":
        return F.lit(True)
    return width > height if mode == "landscape" else words < threshold


def keywords_json(words: Column) -> Column:
    return F.to_json(words)


def keywords_from_json(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def megabytes(size: Column) -> Column:
    """To two digits; ties to even as far as doubles can tell."""
    return F.bround(size / F.lit(1048576.0), 2)
