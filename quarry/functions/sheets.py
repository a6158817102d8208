"""Expressions on sheets: rows are array<array<string>> without nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

MOST_COLUMNS, MOST_HEADERS = 26, 6


def column_letter(n: Column) -> Column:
    """1 is A, 27 is AA, and so on for every number; A for 0 and less."""

    def step(x: Column, _: Column) -> Column:
        left = x["n"] - 1
        digit = F.char(F.pmod(left, F.lit(26)) + 65)
        more = F.struct(F.call_function("div", left, F.lit(26).cast("long")).alias("n"), F.concat(digit, x["s"]).alias("s"))
        return F.when(x["n"] > 0, more).otherwise(x)

    # 14 letters hold every long.
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))
    return F.when(n <= 0, "A").otherwise(F.when(n.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda x: x["s"])))


def is_numeric(cell: Column) -> Column:
    """Whether a number is left without white space at the ends, commas, percent, dollar and pound signs.

    As in Python, inf and nan are numbers, and single underscores may stand between digits.
    """
    plain = F.regexp_replace(strip(cell), "[,%$£]", "")
    digits = r"\d+(_\d+)*"
    return strip(plain).rlike(rf"(?iU)\A[+-]?(({digits}(\.({digits})?)?|\.{digits})(e[+-]?{digits})?|inf(inity)?|nan)\z")


def trimmed(rows: Column) -> Column:
    """Without blank rows and columns at the end."""
    used = F.transform(rows, lambda row: F.coalesce(F.array_max(F.transform(row, lambda c, i: F.when(strip(c) != "", i + 1))), F.lit(0)))

    def cut(used: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(used, lambda n, i: F.when(n > 0, i + 1))), F.lit(0))
        wide = F.coalesce(F.array_max(used), F.lit(0))
        return let(wide, lambda w: F.transform(F.slice(rows, F.lit(1), last), lambda r: F.slice(r, F.lit(1), w)))

    return let(used, cut)


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def has_header(rows: Column) -> Column:
    """At least two rows, and at most half of the first row's cells that aren't blank are numbers."""
    named = F.filter(F.get(rows, F.lit(0)), lambda c: strip(c) != "")
    numbers = F.size(F.filter(named, is_numeric))
    return F.when((F.size(rows) >= 2) & (F.size(named) > 0), 1 - numbers / F.size(named) >= 0.5).otherwise(False)


def markdown(rows: Column, most: int | None = MOST_COLUMNS, strip_cells: bool = True) -> Column:
    """A Markdown table of at most so many columns; '' without rows. Short rows are filled up."""

    def cell(c: Column) -> Column:
        c = F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
        return strip(c) if strip_cells else c

    def table(all_columns: Column) -> Column:
        n = F.least(all_columns, F.lit(most)) if most else all_columns

        def line(row: Column) -> Column:
            padded = F.slice(F.concat(row, F.array_repeat(F.lit(""), n)), F.lit(1), n)
            return F.concat(F.lit("| "), F.array_join(F.transform(padded, cell), " | "), F.lit(" |"))

        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
        lines = F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line))
        if most:
            note = F.concat(F.lit(f"*Truncated: showing {most} of "), all_columns.cast("string"), F.lit(" columns*"))
            lines = F.when(all_columns > most, F.concat(lines, F.array(note))).otherwise(lines)
        return F.array_join(lines, "\n")

    return F.when(F.size(rows) == 0, "").otherwise(let(width(rows), table))


def summary(name: Column, rows: Column) -> Column:
    """One line on a sheet."""
    headers = F.filter(F.get(rows, F.lit(0)), lambda c: strip(c) != "")
    some = F.concat(F.array_join(F.slice(headers, 1, MOST_HEADERS), ", "), F.when(F.size(headers) > MOST_HEADERS, " ...").otherwise(""))
    sheet = F.concat(F.lit("Sheet '"), name, F.lit("': "))
    named = F.concat(sheet, (F.size(rows) - 1).cast("string"), F.lit(" data rows, columns: "), some)
    plain = F.concat(sheet, F.size(rows).cast("string"), F.lit(" rows × "), width(rows).cast("string"), F.lit(" columns"))
    return F.when(F.size(rows) == 0, F.concat(F.lit("Empty sheet: "), name)).when(has_header(rows), named).otherwise(plain)


def a1_range(rows: Column) -> Column:
    return F.concat(F.lit("A1:"), column_letter(width(rows)), F.size(rows).cast("string"))


def plain_text(name: Column, rows: Column) -> Column:
    head = F.array(F.concat(F.lit("Sheet: "), name), summary(name, rows), F.lit(""))
    return F.array_join(F.concat(head, F.transform(rows, lambda r: F.array_join(r, " | "))), "\n")


def sheet_element(name: Column, rows: Column) -> Column:
    """The element of a sheet; rows are trimmed first. A blank sheet has none (null)."""

    def element(rows: Column) -> Column:
        made = F.struct(
            F.lit("sheet").alias("element_type"), plain_text(name, rows).alias("text"), name.alias("section_path"), name.alias("page_or_sheet"),
            markdown(rows).alias("html_or_markdown"), a1_range(rows).alias("source_range"), summary(name, rows).alias("summary"),
        )
        return F.when(F.size(rows) > 0, made)

    return let(trimmed(rows), element)
